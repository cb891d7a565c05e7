"""MinHash near-duplicates with sequential Bayesian verification.

1. Each text becomes its set of word shingles. Texts with equal sets form one class (two 64-bit sums over the set and
   its size); only the smallest doc_id of a class goes on.
2. A class has ``BANDS * ROWS`` min-hashes. Classes that agree on all rows of a band share a bucket; a pair at the
   threshold shares none with probability (1 - 0.75**4)**32, 5 in a million.
3. Links are sought in passes, and each one leaves out what earlier ones have connected. The first ``STARS`` passes pair the
   members of each bucket with one of them, another one in each band and pass; the rows they make are those of the buckets. The buckets
   whose members are then still in different components make up families (classes that buckets connect). A family is
   cut into tiles, and in a tile every pair that shares a bucket and is not connected yet is compared, so no link that
   joins components is lost; only links leave the task, never the pairs.
4. A pair's signatures are compared in batches. With a uniform prior on similarity, after n hashes of which m agree its
   posterior is Beta(m + 1, n - m + 1); the pair is dropped as soon as P(similarity >= threshold) is below ``MISS``.
5. What is left of a pass is confirmed on the full sets: 100 * intersection >= 75 * union.

Defined cases: texts that are null or have no words have an empty set and link with nothing; texts under five words are one
shingle; texts of any length are read whole; a doc_id names one text, so rows that share it get one component, and if their texts differ,
each text's class counts as linked with the others but links beyond them are sought for one text of the id, that of the
least hash; a null doc_id links with nothing; columns other than id and text are not read, whatever their names; an empty table gives
no rows.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.store import cut, scope
from tidemark.llm.textbytes import chunks, mix, shingle_hashes

SHINGLE_WORDS = 5
THRESHOLD = (75, 100)
BANDS, ROWS = 32, 4
BATCH = 16
#: A pair is given up when the posterior probability that it reaches the threshold falls below this.
MISS = 1e-4

_rng = np.random.Generator(np.random.PCG64(7))
_MUL = _rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)

#: Passes over the buckets before families are compared in tiles.
STARS = 2

SIGNATURES = "doc_id long, h long, n long, k1 long, k2 long, bands array<long>, sig binary"


def min_hashes(own: np.ndarray) -> np.ndarray:
    """``BANDS * ROWS`` min-hashes of a non-empty set of 64-bit hashes."""
    x = (own >> np.uint64(32)).astype(np.uint32)
    out = np.full(BANDS * ROWS, 0xFFFFFFFF, dtype=np.uint32)
    for k in range(0, len(x), 512):  # stays in the cache, whatever the length of the text
        out = np.minimum(out, (x[k : k + 512] * _MUL[:, None] + _ADD[:, None]).min(axis=1))
    return out


def shingle_signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: hash of its text, size of its set, two sums that tell sets apart, bucket of each band, low halves of the min-hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = mix(np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(8))
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(2)):
                hashes, at = shingle_hashes(data, offsets, SHINGLE_WORDS)
                n, k1, k2, bands, sigs = [], [], [], [], []
                for row in range(b - a):
                    own = np.unique(hashes[at[row] : at[row + 1]])
                    n.append(len(own))
                    if not len(own):
                        k1.append(0), k2.append(0), bands.append(None), sigs.append(None)
                        continue
                    k1.append(int(own.sum().view(np.int64)))
                    k2.append(int(mix(own + np.uint64(99)).sum().view(np.int64)))
                    mins = min_hashes(own)
                    key = salt.copy()
                    for r in range(ROWS):
                        key = mix(key ^ mins[r::ROWS].astype(np.uint64))
                    bands.append(key.view(np.int64))
                    sigs.append((mins & np.uint32(0xFFFF)).astype("<u2").tobytes())
                arrays = [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n, pa.int64()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sigs, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "h", "n", "k1", "k2", "bands", "sig"])

    text = F.col(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, SIGNATURES)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(rep, set): the distinct shingle hashes of each text of (rep, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                hashes, at = shingle_hashes(data, offsets, SHINGLE_WORDS)
                sets = [np.unique(hashes[at[r] : at[r + 1]]).view(np.int64) for r in range(b - a)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(sets, pa.list_(pa.int64()))], ["rep", "set"])

    return docs.mapInArrow(run, "rep long, set array<long>")


@functools.cache
def needed(threshold: float = THRESHOLD[0] / THRESHOLD[1], miss: float = MISS) -> np.ndarray:
    """For each batch, the fewest agreeing hashes with which P(similarity >= threshold) is ``miss`` or more."""
    out = []
    for n in range(BATCH, BANDS * ROWS + 1, BATCH):
        # P(Beta(m + 1, n - m + 1) >= t) is P(Binomial(n + 1, t) <= m)
        mass, m = 0.0, -1
        while mass < miss:
            m += 1
            mass += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out.append(m)
    return np.array(out)


def plausible(pairs: DataFrame, sigs: DataFrame) -> DataFrame:
    """Pairs (a, b) that every batch of their signatures leaves plausible."""
    left = sigs.select(F.col("rep").alias("a"), F.col("sig").alias("sa"))
    right = sigs.select(F.col("rep").alias("b"), F.col("sig").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = needed()
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), dtype="<u2").reshape(-1, BANDS * ROWS) for c in ("sa", "sb"))
            alive = np.arange(len(x))
            agree = np.zeros(len(x), dtype=np.int64)
            for k, fewest in enumerate(least):
                some = slice(k * BATCH, (k + 1) * BATCH)
                agree[alive] += (x[alive, some] == y[alive, some]).sum(axis=1)
                alive = alive[agree[alive] >= fewest]
            yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(alive)), batch.column("b").take(pa.array(alive))], ["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def enough(shared: Column, n_a: Column, n_b: Column) -> Column:
    return shared * THRESHOLD[1] >= (n_a + n_b - shared) * THRESHOLD[0]


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full sets reach the threshold. texts: (rep, text)."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    sets = cut(shingle_sets(texts.join(ids, "rep", "left_semi").select("rep", "text")))
    left = sets.select(F.col("rep").alias("a"), F.col("set").alias("xa"))
    right = sets.select(F.col("rep").alias("b"), F.col("set").alias("xb"))
    both = pairs.join(right, "b").join(left, "a")
    return both.where(enough(F.size(F.array_intersect("xa", "xb")), F.size("xa"), F.size("xb"))).select("a", "b")


#: Classes on either side of a tile.
TILE_ROWS = 1024


class Forest:
    """Union of small sets of labels within a task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.find(x), self.find(y)
        self.up[max(x, y)] = min(x, y)


def tile_links(left: pd.DataFrame, right: pd.DataFrame) -> list[tuple[int, int]]:
    """Links between two sides (or within one) that join components, each confirmed on the full sets.

    Pairs that share a bucket and have different roots are compared batch by batch, and what is left is confirmed in the
    order of agreement while its components are apart.
    """
    sides = []
    for side in (left, right):
        side = side.sort_values("root", kind="stable")
        sig = np.frombuffer(b"".join(side["sig"]), dtype="<u2").reshape(-1, BANDS * ROWS)
        sides.append((side["rep"].to_numpy(), side["root"].to_numpy(), np.stack(side["bands"].to_numpy()), sig, side["set"].tolist()))
    (rep_a, root_a, bands_a, sig_a, set_a), (rep_b, root_b, bands_b, sig_b, set_b) = sides
    least, found = needed(), []
    for k in range(0, len(rep_a), 64):
        part = slice(k, k + 64)
        # of a large component only what lies outside it is looked at
        other = np.flatnonzero(root_b != root_a[k]) if root_a[k] == root_a[part][-1] else np.arange(len(rep_b))
        shared = np.zeros((len(rep_a[part]), len(other)), dtype=bool)
        for band in range(BANDS):
            shared |= bands_a[part, band, None] == bands_b[None, other, band]
        shared &= root_a[part, None] != root_b[None, other]
        if left is right:
            shared &= rep_a[part, None] < rep_b[None, other]
        i, j = np.nonzero(shared)
        i, j = i + k, other[j]
        agree = np.zeros(len(i), dtype=np.int64)
        for step, fewest in enumerate(least):
            some = slice(step * BATCH, (step + 1) * BATCH)
            agree += (sig_a[i, some] == sig_b[j, some]).sum(axis=1)
            alive = agree >= fewest
            i, j, agree = i[alive], j[alive], agree[alive]
        found.append((agree, i, j))
    agree, i, j = (np.concatenate([f[c] for f in found]) for c in range(3))
    links, forest = [], Forest()
    for k in np.argsort(-agree, kind="stable"):
        x, y = i[k], j[k]
        if forest.find(int(root_a[x])) != forest.find(int(root_b[y])):
            one, another = set_a[x], set_b[y]
            both = len(np.intersect1d(one, another, assume_unique=True))
            if both * THRESHOLD[1] >= (len(one) + len(another) - both) * THRESHOLD[0]:
                forest.join(int(root_a[x]), int(root_b[y]))
                links.append((int(rep_a[x]), int(rep_b[y])))
    return links


def open_members(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, bucket, rep, root) of the buckets whose members have several roots."""
    placed = members.select("band", "bucket", "rep")
    at = placed.join(roots, placed["rep"] == roots["node"], "left").select("band", "bucket", "rep", F.coalesce("root", "rep").alias("root"))
    mixed = cut(at.groupBy("band", "bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("band", "bucket"))
    return cut(at.join(mixed, ["band", "bucket"]))


def star_pairs(members: DataFrame, turn: int) -> DataFrame:
    """(a, b): each member of a bucket with the bucket's pivot, if their roots differ."""
    first = F.min(F.struct(F.xxhash64("rep", "band", F.lit(turn)).alias("h"), "rep", "root"))
    pivots = cut(members.groupBy("band", "bucket").agg(first.alias("first")).select("band", "bucket", F.col("first.rep").alias("pivot"), F.col("first.root").alias("other")))
    pairs = members.join(pivots, ["band", "bucket"]).where("root != other")
    return pairs.select(F.least("rep", "pivot").alias("a"), F.greatest("rep", "pivot").alias("b")).distinct()


def families(members: DataFrame) -> DataFrame:
    """(rep, family): classes that buckets connect."""
    pivots = cut(members.groupBy("band", "bucket").agg(F.min("rep").alias("pivot")))
    edges = members.join(pivots, ["band", "bucket"]).select(F.col("rep").alias("a"), F.col("pivot").alias("b"))
    return cut(components(edges).select(F.col("node").alias("rep"), F.col("root").alias("family")))


def family_links(members: DataFrame, own: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different roots that share one of the buckets of ``members``; see :func:`tile_links`."""
    family = cut(members.select("rep", "root").distinct().join(families(members), "rep"))
    sizes = cut(family.groupBy("family").agg(F.count("*").alias("n")))
    small = sizes.where(F.col("n") <= TILE_ROWS).agg(F.sum("n")).first()[0] or 0
    pools = 1 + small // TILE_ROWS
    # small families share pools; a large one has chunks, and a tile for each two of them
    chunks_ = F.when(F.col("n") > TILE_ROWS, F.ceil(F.col("n") / TILE_ROWS)).otherwise(F.lit(1)).cast("int")
    pool = F.when(F.col("n") > TILE_ROWS, F.col("family")).otherwise(-1 - F.pmod(F.xxhash64("family"), F.lit(pools)))
    dealt = family.join(sizes, "family").select("rep", "root", pool.alias("pool"), chunks_.alias("chunks"))
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), F.col("chunks")).cast("int")).join(own, "rep")
    dealt = dealt.join(shingle_sets(texts.join(family.select("rep"), "rep", "left_semi").select("rep", "text")), "rep")
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    tiles = tiles.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))

    def solve(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        left = rows[rows["chunk"] == key[1]]
        right = left if key[1] == key[2] else rows[rows["chunk"] == key[2]]
        links = tile_links(left, right) if len(left) and len(right) else []
        return pd.DataFrame({"a": [min(x) for x in links], "b": [max(x) for x in links]}, dtype="int64")

    return tiles.select("pool", "i", "j", "chunk", "rep", "root", "bands", "sig", "set").groupBy("pool", "i", "j").applyInPandas(solve, "a long, b long")


def joined_to(roots: DataFrame) -> DataFrame:
    """Edges (a, b) from each node to its root."""
    return roots.where("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id): class_id is the smallest doc_id with an equal set."""
    with scope(docs.sparkSession) as tables:
        signed = cut(shingle_signatures(docs, id_col, text_col))
        # a table of its own, so that the join deals both sides anew and can split a very frequent text
        classes = cut(signed.where("n > 0 and doc_id is not null").groupBy("n", "k1", "k2").agg(F.min("doc_id").alias("rep")))
        one = signed.join(classes, ["n", "k1", "k2"])
        member = cut(one.select(F.col("doc_id"), "rep"))
        own = cut(one.where("doc_id = rep").groupBy("rep").agg(F.min(F.struct("h", "bands", "sig")).alias("_")).select("rep", "_.h", "_.bands", "_.sig"))
        sigs = own.select("rep", "sig")
        # only buckets of two or more go on
        placed = own.select("rep", F.posexplode("bands").alias("band", "bucket"))
        several = cut(placed.groupBy("band", "bucket").count().where("count > 1").drop("count"))
        placed = cut(placed.join(several, ["band", "bucket"]).select("band", "bucket", "rep"))
        texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.xxhash64(F.col(text_col)).alias("h"), F.col(text_col).alias("text"))
        # the texts of candidates, moved once; what follows needs no others
        wanted = own.select("rep", "h").join(placed.select("rep").distinct(), "rep", "left_semi")
        texts = cut(texts.join(wanted, ["rep", "h"], "left_semi").dropDuplicates(["rep"]).select("rep", "text"))

        members, roots = placed.withColumn("root", F.col("rep")), None
        for turn in range(STARS + 1):
            links = confirmed(cut(plausible(star_pairs(members, turn), sigs)), texts) if turn < STARS else family_links(members, own, texts)
            # what is connected goes on as one edge for each node
            roots = components(links if roots is None else joined_to(roots).union(links))
            if turn < STARS:
                members = open_members(members, roots)
        # rows that share a doc_id join their classes
        shared = member.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b")).where("a < b").select("a", "b")
        found = components(joined_to(roots).union(shared))
        tables.keep(signed, member, found)
    out = member.distinct().join(found, F.col("rep") == F.col("node"), "left").select("doc_id", "rep", F.coalesce("root", "rep").alias("root"))
    out = out.groupBy("doc_id").agg(F.min("rep").alias("rep"), F.min("root").alias("root"))
    return signed.select("doc_id", F.col("n").alias("n_shingles")).join(out, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("rep", "doc_id").alias("class_id"), F.coalesce("root", "doc_id").alias("component_id")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id; rows without words or id stay, and so do rows that repeat the kept id."""
    found = near_duplicates(docs, id_col, text_col).where("component_id != doc_id").select(F.col("doc_id").alias("_other")).distinct()
    spare = docs.join(found, docs[id_col] == found["_other"], "left_anti")
    return spare
