"""Remove repeated byte strings: every byte that a string of ``LENGTH`` bytes covers which also starts anywhere else.

Equal windows are brought together first. The windows of a document (its strings of ``LENGTH`` bytes) that share their
least ``GRAM``-byte hash, at one place, form a segment; the hash is its anchor. Equal windows have equal anchors at equal
offsets, so all that can repeat lies in segments whose anchor occurs at least twice, and only those go on. Segments that are
equal as a whole are one string with a count.

Suffix arrays then decide every window. The windows of a segment are split into chunks of ``WIDTH`` neighbours, which share all
but the outer bytes, their core; a chunk is the string of its left bytes, one symbol for the core and its right bytes, so
that each window is ``WIDTH`` symbols long. Equal strings are one with a count again; a core that occurs once repeats
nowhere, and where all strings around a core are one, there is nothing to compare: each of its windows repeats. All other
strings are dealt by core to shards of about ``SHARD_SYMBOLS``, and each shard's array is built by induced
sorting: suffixes are classified, leftmost-smaller substrings sorted and named, recursively, and the array induced from
them in two linear scans; permuted common prefixes then show which windows of the shard are equal. Only a core with more
than ``MOST_CHUNKS`` different surroundings (the edge of a passage that very many documents quote) would not fit one task;
its windows are counted one by one instead, partly before they are shuffled, with the same result.

Where a hash stands for bytes (a segment as a whole, a core) it has 128 bits. Strings are judged on the input. Defined cases: a null
text is empty; documents shorter than ``LENGTH`` lose nothing; every row is a document, so repeated rows are copies of each
other, and rows with a null id are documents too; texts of any length are read in slices; columns other than id and text are not read,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import cut, discard
from tidemark.llm.suffix import permuted_prefixes, suffix_array
from tidemark.llm.textbytes import CHUNK, SECOND, chunks, prefix_hash, span_hash

LENGTH = 400
GRAM = 100
#: Windows of a chunk.
WIDTH = 48
SHARD_SYMBOLS = 1 << 18
MOST_CHUNKS = 20_000

_PLACE = np.uint64((1 << 22) - 1)
SEGMENTS = "doc long, h long, p int, lo int, hi int, g long, c long, c2 long"


def window_anchors(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window start of ``data``: the place of the least hash of its grams (leftmost of equals); all grams' hashes; prefix sums."""
    prefix = prefix_hash(data)
    starts = np.arange(len(data) - gram + 1)
    grams = span_hash(prefix, starts, starts + gram)
    w = length - gram + 1
    n = len(grams) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64), grams, prefix
    key = (grams & ~_PLACE) | starts.astype(np.uint64)
    pad = -len(key) % w
    rows = np.concatenate([key, np.full(pad, np.uint64(0xFFFFFFFFFFFFFFFF))]).reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(back[:n], ahead[w - 1 : w - 1 + n])
    return (least & _PLACE).astype(np.int64), grams, prefix


def segments(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """A row for each run of windows with one anchor: place p of the anchor, first and last start, anchor g, hashes c and c2 of its bytes. docs: (doc, h, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "h", "p", "lo", "hi", "g", "c", "c2"]
        for batch in batches:
            doc, h = batch.column(0), batch.column(1)
            for a, _, data, offsets in chunks(batch.column(2)):
                base = 0
                while base + length <= len(data):
                    # a slice of a long text takes whole runs only: the last one is left to the next slice, so no anchor comes twice
                    some = data[base : base + CHUNK + length - 1]
                    at, grams, prefix = window_anchors(some, length, gram)
                    other = prefix_hash(some, powers=SECOND)
                    start = np.arange(len(at)) + base
                    row = np.searchsorted(offsets, start, side="right") - 1
                    inside = start + length <= offsets[row + 1]
                    head = np.concatenate([[True], (at[1:] != at[:-1]) | (row[1:] != row[:-1]) | ~inside[:-1]]) & inside
                    first = np.flatnonzero(head)
                    done = base + len(some) == len(data)
                    if not done and len(first) and first[-1]:
                        cut_at = int(first[-1])
                        first, inside = first[:-1], inside & (np.arange(len(at)) < cut_at)
                        head = head & inside
                        base += cut_at
                    else:
                        base += len(at)
                    if not len(first):
                        continue
                    runs = np.cumsum(head)[inside] - 1
                    last = np.zeros(len(first), dtype=np.int64)
                    last[runs] = np.flatnonzero(inside)
                    own = row[first]
                    shift = start[0] - offsets[own]
                    yield pa.RecordBatch.from_arrays(
                        [doc.take(pa.array(own + a)), h.take(pa.array(own + a))]
                        + [pa.array((x + shift).astype(np.int32)) for x in (at[first], first, last)]
                        + [pa.array(x.view(np.int64)) for x in (grams[at[first]], span_hash(prefix, first, last + length), span_hash(other, first, last + length, SECOND))],
                        names,
                    )

    return docs.mapInArrow(run, SEGMENTS)


def repeated_windows(lefts: list[bytes], cores: np.ndarray, rights: list[bytes], counts: np.ndarray, width: int) -> list[np.ndarray]:
    """For each string left + core + right, how many left bytes its windows take that also occur elsewhere, or in a string that counts twice.

    A window is ``width`` symbols long and holds the core.
    """
    _, symbol = np.unique(cores, return_inverse=True)
    size = np.array([len(a) + len(b) + 2 for a, b in zip(lefts, rights, strict=True)])
    begin = np.concatenate([[0], np.cumsum(size)])[:-1]
    body = np.frombuffer(b"".join(a + b"\0" + b + b"\0" for a, b in zip(lefts, rights, strict=True)), dtype=np.uint8).astype(np.int64) + 2
    middle = begin + [len(a) for a in lefts]
    body[middle] = 258 + symbol
    body[begin + size - 1] = 1
    body = np.append(body, 0)
    weight = np.zeros(len(body), dtype=np.int64)
    low = np.array([max(0, width - 1 - len(b)) for b in rights])  # fewer left bytes need more on the right than there are
    for at, n, least, k in zip(begin, middle - begin, low, counts, strict=True):
        weight[at : at + max(0, n - least + 1)] = k
    sa = suffix_array(body)
    group = np.cumsum(permuted_prefixes(body, sa, width)[sa] < width)
    total = np.bincount(group, weights=weight[sa])
    repeated = np.zeros(len(body), dtype=bool)
    repeated[sa] = total[group] >= 2
    repeated &= weight > 0
    return [np.flatnonzero(repeated[at : m + 1][::-1]) for at, m in zip(begin, middle, strict=True)]


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each run of True."""
    edge = np.diff(np.concatenate([[0], mask.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


CORE = ["g", "k", "core", "core2"]
CHUNKS = "id long, n long, g long, k int, core long, core2 long, x binary, y binary"


def chunks_of(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """(id, n, g, k, core, core2, x, y): chunks of the class representatives in ``wanted``, (id, g, n, first): hashes of the core, bytes left and right of it.

    Chunk k has the windows that begin ``k * WIDTH`` to ``k * WIDTH + WIDTH - 1`` bytes before the anchor.
    """
    part = F.struct("id", "g", "n", F.col("first.p").alias("p"), F.col("first.lo").alias("lo"), F.col("first.hi").alias("hi"))
    per_doc = wanted.groupBy(F.col("first.doc").alias("d2"), F.col("first.h").alias("h2")).agg(F.collect_list(part).alias("parts"))
    # rows that repeat are equal, so one of them serves
    both = docs.join(per_doc, docs["doc"].eqNullSafe(per_doc["d2"]) & (docs["h"] == per_doc["h2"])).select("text", "parts")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
    width, names = WIDTH, [c.split()[0] for c in CHUNKS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = width - 1
        made = lambda out: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for row in range(batch.num_rows):
                text = batch.column(0)[row].as_py().encode()
                parts = batch.column(1)[row].as_py()
                # hashes of the bytes around the anchors, a slice of the document at a time
                parts.sort(key=lambda x: x["lo"])
                base = end = 0
                for x in parts:
                    p, lo, hi = x["p"], x["lo"], x["hi"]
                    if hi + length + edge > end:
                        base = max(0, lo - edge)
                        end = max(hi + length + edge, min(len(text), base + CHUNK // 8))
                        some = np.frombuffer(text[base:end], dtype=np.uint8)
                        prefix, other = prefix_hash(some), prefix_hash(some, powers=SECOND)
                    k = np.arange((p - hi) // width, (p - lo) // width + 1)
                    a = p - k * width
                    b = a + length - edge
                    core = span_hash(prefix, a - base, b - base).view(np.int64).tolist()
                    core2 = span_hash(other, a - base, b - base, SECOND).view(np.int64).tolist()
                    n = len(k)
                    for c, v in zip(out, ([x["id"]] * n, [x["n"]] * n, [x["g"]] * n, k.tolist(), core, core2, [text[max(0, i - edge) : i] for i in a.tolist()], [text[j : j + edge] for j in b.tolist()]), strict=True):
                        c.extend(v)
                if len(out[0]) > 8192:
                    yield made(out)
                    out = [[] for _ in names]
            yield made(out)

    return both.mapInArrow(run, CHUNKS).dropDuplicates(["id", "k"])


def by_suffix_arrays(strings: DataFrame, shards: int) -> DataFrame:
    """(CORE, x, y, js): numbers of left bytes of the repeated windows of each string (CORE, x, y, n)."""
    width = WIDTH

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.groupby(CORE).ngroup().to_numpy()
        found = repeated_windows(rows["x"].tolist(), own, rows["y"].tolist(), rows["n"].to_numpy(), width)
        return rows[[*CORE, "x", "y"]].assign(js=[f.astype(np.int32) for f in found])

    dealt = strings.select(*CORE, "x", "y", "n").withColumn("shard", F.pmod(F.xxhash64(*CORE), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(solve, "g long, k int, core long, core2 long, x binary, y binary, js array<int>")


def lefts() -> Column:
    """Numbers of left bytes of all windows of a string."""
    low = F.greatest(F.lit(0), WIDTH - 1 - F.length("y"))
    return F.when(low <= F.length("x"), F.sequence(low, F.length("x")))


def by_windows(strings: DataFrame) -> DataFrame:
    """Like :func:`by_suffix_arrays`, for cores of any number of surroundings: every window's own bytes are counted."""
    edge = WIDTH - 1
    each = strings.withColumn("j", F.explode(lefts()))
    each = each.withColumn("a", F.substring(F.col("x"), F.length("x") - F.col("j") + 1, F.col("j"))).withColumn("b", F.substring(F.col("y"), F.lit(1), edge - F.col("j")))
    key = [*CORE, "j", "a", "b"]
    twice = each.groupBy(*key).agg(F.sum("n").alias("times")).where("times > 1").select(*key)
    return each.join(twice, key).groupBy(*CORE, "x", "y").agg(F.collect_list("j").alias("js"))


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(d2, h2, spans): byte spans that go, which may overlap, for each document that loses any. docs: (doc, h, text)."""
    every = cut(segments(docs, length, gram))
    # a table of its own, so that the join deals both sides anew and can split a very frequent anchor
    often = cut(every.groupBy("g").count().where("count > 1").select("g"))
    repeated = cut(every.join(often, "g", "left_semi").withColumn("off", F.col("p") - F.col("lo")).withColumn("span", F.col("hi") - F.col("lo")))
    discard(every, often)
    same = ["g", "off", "span", "c", "c2"]
    classes = repeated.groupBy(*same).agg(F.count("*").alias("n"), F.min(F.struct("doc", "h", "p", "lo", "hi")).alias("first"))
    classes = cut(classes.withColumn("id", F.monotonically_increasing_id()))
    pieces = cut(chunks_of(docs, classes.select("id", "g", "n", "first"), length))
    every = cut(pieces.groupBy(*CORE, "x", "y").agg(F.sum("n").alias("n")))
    cores = cut(every.groupBy(*CORE).agg(F.count("*").alias("kinds"), F.sum("n").alias("times")).where("times > 1").drop("times"))
    strings = cut(every.join(cores, CORE))
    discard(every, cores)
    alone, few = F.col("kinds") == 1, F.col("kinds").between(2, MOST_CHUNKS)
    size, most = strings.agg(F.sum(F.when(few, F.length("x") + F.length("y") + 2)), F.max("kinds")).first()
    found = by_suffix_arrays(strings.where(few), 1 + (size or 0) // SHARD_SYMBOLS)
    found = found.union(strings.where(alone).select(*CORE, "x", "y", lefts().alias("js")))
    if (most or 0) > MOST_CHUNKS:
        found = found.union(by_windows(strings.where(F.col("kinds") > max(1, MOST_CHUNKS)).drop("kinds")))
    windows = pieces.join(found.where(F.size("js") > 0), [*CORE, "x", "y"]).join(classes.select("id", "off", "span"), "id")
    start = lambda j: F.col("off") - F.col("k") * WIDTH - j
    starts = F.filter(F.transform("js", start), lambda a: (a >= 0) & (a <= F.col("span")))
    own = windows.select("id", starts.alias("at")).where(F.size("at") > 0).groupBy("id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("at")))).alias("at"))
    # starts in a row are one run
    begins = F.filter("at", lambda a, i: (i == 0) | (F.get("at", i - 1) < a - 1))
    ends = F.filter("at", lambda a, i: (i == F.size("at") - 1) | (F.get("at", i + 1) > a + 1))
    own = own.select("id", F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("runs"))
    covered = classes.join(own, "id").select(*same, "runs")
    at = F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"] + length).alias("b")))
    found = repeated.join(covered, same).select(F.col("doc").alias("d2"), F.col("h").alias("h2"), at.alias("spans"))
    # rows that repeat an id and a text have equal spans, each kept once
    return found.groupBy("d2", "h2").agg(F.flatten(F.collect_set("spans")).alias("spans"))


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def dedup_substrings(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): sizes, maximal removed runs, and the bytes that stay."""
    keyed = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select("doc", F.xxhash64("text").alias("h"), "text")
    spans = repeated_spans(keyed, length, gram)
    both = keyed.join(spans, keyed["doc"].eqNullSafe(spans["d2"]) & (keyed["h"] == spans["h2"]), "left").select("doc", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                out: tuple[list, ...] = ([], [], [], [], [])
                some = batch.slice(k, 256)
                gone = some.column(2)
                flat = gone.flatten()
                upto = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))])
                start, end = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                for row, (doc, text) in enumerate(zip(some.column(0).to_pylist(), some.column(1), strict=True)):
                    body = np.frombuffer(text.as_py().encode(), dtype=np.uint8)
                    edge = np.zeros(len(body) + 1, dtype=np.int32)
                    np.add.at(edge, start[upto[row] : upto[row + 1]], 1)
                    np.add.at(edge, end[upto[row] : upto[row + 1]], -1)
                    removed = np.cumsum(edge)[:-1] > 0
                    for c, v in zip(out, (doc, len(body), int(removed.sum()), len(runs_of(removed)[0]), body[~removed].tobytes()), strict=True):
                        c.append(v)
                types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(run, RESULT)
