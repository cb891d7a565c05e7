"""Best-fit packing of tokenised documents into sequences of a fixed length, in bulk-synchronous sweeps.

Pieces are sorted by range and numbered inside their length by :func:`tidemark.llm.store.ranked`. From then on documents and
gaps are tables of runs: (length, first rank, documents) and (room, first sequence, sequences). A length is an integer of
at most ``max_tokens``, so there are at most that many runs of documents to begin with.

A superstep is one Spark job over both tables:

1. Gaps lie in ranges of ``RANGE`` sizes. Each run of documents goes to the range that holds its successor, the smallest gap
   with room for it: its own range if the largest gap there has room, else the next range that has gaps.
2. The task of a range sweeps over its documents and gaps in order of size. Where several runs want one gap, the rank decides:
   the longest document first, then the smaller number in the order of pieces. A run takes the gaps of a size in turn, each
   with as many of its documents as have room.
3. Gaps are updated: what room is left is a gap of another size, in the range of that size. Documents that found their range
   full go to the next superstep, with all others that wait.

Sequences are opened only where every packing must open them: for the tokens that exceed all gaps, and for the documents
that no gap has room for (:func:`must_open`). While there are no gaps yet, all documents want the same fresh sequences; that
one range is dealt over shares, each with its part of every run and of the sequences, and what a share leaves meets in the
next superstep. A few supersteps place all. Their claims, at most some thousands for each share and superstep (a claim
ends a run of documents or a run of gaps, and a gap's room at least halves when a run ends it), go to the executors, where
(length, rank) becomes (sequence, offset) by binary search.

Defined cases: a null text is an empty one, which has the closing id alone; texts of any length are tokenised whole, and those longer than
a sequence are cut into whole sequences and a rest; rows that repeat a doc_id are packed each on its own; a null doc_id is kept; other
columns are not read, whatever their names; an empty table gives no rows.

With a column of places (a mixture's, say), pieces of equal length claim sequences in the order of places instead of ids,
and sequences are numbered by their earliest place. The lengths that share a sequence stay the same, so no sequence is added.
"""

from __future__ import annotations

import bisect
import functools
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator, Sequence
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import cut, discard, ranked
from tidemark.llm.textbytes import chunks, prefix_hash, span_hash, words

MAX_TOKENS = 4096
END_ID = 1
#: A Python worker remembers the ids of so many parts of texts, in arrays of about 50 MB, and then starts anew.
PARTS = 1 << 20

#: Sizes of a range of gaps; fresh sequences of a share, and the most shares, when all documents want fresh sequences.
RANGE, SHARE_SEQUENCES, SHARES = 256, 4096, 32
DOC, GAP, CLAIM = 0, 1, 2
#: Runs: documents (a: length, b: first rank), gaps (a: room, b: first sequence, each: the share they are dealt to) or claims.
STATE = "kind long, a long, b long, n long, each long, seq long, offset long"

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


_MARK_LETTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_MARKS = np.zeros(256, dtype=bool)
_MARKS[list(_MARK_LETTERS.encode())] = True
_PROBES = ("One,two  THREE!! four.\n(five) six... Seven", "ÉTÉ naïve, Straße? 日本語 x1y2-z Ünïcode", "don't 3.14 a_b c-d end.")
#: Byte-level vocabularies write bytes that do not print as the letters from U+0100 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_LETTERS = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class PartTokenizer:
    """Ids of texts by ``tokenizers``, remembered for each part of a text.

    For tokenizers that drop white space, lower-case, and never join a run of letters with what surrounds it, such as the
    one used here: the ids of a text are those of its words (between ASCII white space), one after the other, and a word
    made of letters with ASCII marks behind them has the ids of the letters and of the marks. Parts are found by hash in
    an open table, for all words of a slice at once; only parts that are new reach the tokenizer. A text with ``<|``,
    which may begin a special token, goes to the tokenizer whole. A vocabulary file for which this does not hold on
    ``_PROBES`` is refused with an error.
    """

    def __init__(self, path: str, most: int = PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.most = most
        for probe in _PROBES:
            bare = [(word, word.rstrip(_MARK_LETTERS)) for word in probe.split()]
            parts = [part for word, own in bare for part in ((own, word[len(own) :]) if own.isalpha() else (word,)) if part]
            if self.tokenizer.encode(probe, add_special_tokens=False).ids != [i for part in parts for i in self._encode(part)]:
                raise ValueError(f"{path}: ids of a text are not those of its parts")
        self._clear()

    def _clear(self) -> None:
        self.keys = np.zeros(2 * self.most, dtype=np.uint64)  # 0: free
        self.entry = np.zeros(2 * self.most, dtype=np.int32)
        self.count = self.used = 0
        self.start, self.size = np.zeros(1024, dtype=np.int64), np.zeros(1024, dtype=np.int64)
        self.letters = np.zeros(1024, dtype=bool)
        self.flat = np.zeros(4096, dtype=np.uint32)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of the hashes, -1 for those not known."""
        mask = np.uint64(len(self.keys) - 1)
        out = np.full(len(hashes), -1, dtype=np.int64)
        slot, left = (hashes & mask).astype(np.int64), np.arange(len(hashes))
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.entry[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & int(mask)
        return out

    def _encode(self, part: str) -> list[int]:
        """What the whole tokenizer gives; a run of letters is a single word of its model, which is asked directly."""
        own = part.lower() if part.isascii() else self.normalizer.normalize_str(part)
        if not own.isalpha():
            return self.tokenizer.encode(part, add_special_tokens=False).ids
        if not own.isascii():
            own = own.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return [t.id for t in self.model.tokenize(own)]

    def _add(self, hashes: np.ndarray, parts: list[str]) -> None:
        """Learn distinct new hashes."""
        ids = [self._encode(p) for p in parts]
        size = np.array([len(i) for i in ids], dtype=np.int64)
        flat = np.array([x for i in ids for x in i], dtype=np.uint32)
        n, end = self.count + len(parts), self.used + len(flat)
        while n > len(self.start):
            self.start, self.size, self.letters = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.letters))
        while end > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : end] = flat
        self.size[self.count : n] = size
        self.start[self.count : n] = self.used + np.cumsum(size) - size
        self.letters[self.count : n] = [p.isalpha() for p in parts]
        if 4 * n > 3 * len(self.keys):  # one very long text can bring more than a worker keeps
            held = self.keys != 0
            known, entries = self.keys[held], self.entry[held]
            self.keys, self.entry = np.zeros(2 * len(self.keys), dtype=np.uint64), np.zeros(2 * len(self.keys), dtype=np.int32)
            self._insert(known, entries)
        self._insert(hashes, np.arange(self.count, n))
        self.count, self.used = n, end

    def _insert(self, hashes: np.ndarray, entries: np.ndarray) -> None:
        """Put distinct hashes that are not there yet into free places."""
        mask = len(self.keys) - 1
        slot, left = (hashes & np.uint64(mask)).astype(np.int64), np.arange(len(hashes))
        while len(left):
            free = self.keys[slot] == 0
            at, first = np.unique(slot[free], return_index=True)
            put = left[free][first]
            self.keys[at], self.entry[at] = hashes[put], entries[put]
            on = self.keys[slot] != hashes[left]
            left, slot = left[on], (slot[on] + 1) & mask

    def _entries(self, prefix: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        hashes = np.maximum(span_hash(prefix, start, end), np.uint64(1))
        found = self._find(hashes)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, first = np.unique(hashes[missing], return_index=True)
            at = missing[first]
            body = data.tobytes()
            for k in range(0, len(new), 8192):
                self._add(new[k : k + 8192], [body[a:b].decode() for a, b in zip(start[at[k : k + 8192]], end[at[k : k + 8192]], strict=True)])
            found[missing] = self._find(hashes[missing])
        return found

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts of a slice, and the offsets of each text's own."""
        if self.count > self.most - (1 << 18) and self.count:
            self._clear()
        start, end, first = words(data, offsets)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
        prefix = prefix_hash(data, fold=True)
        # the last byte before each place that is no mark
        solid = np.maximum.accumulate(np.where(_MARKS[data], -1, np.arange(len(data))))
        cut = np.maximum(solid[end - 1] + 1, start)
        n = len(start)
        unit = np.full((n, 2), -1, dtype=np.int64)
        some = cut > start
        unit[some, 0] = self._entries(prefix, data, start[some], cut[some])
        plain = ~some
        plain[some] = self.letters[unit[some, 0]]
        tail = end > cut
        both = tail & plain
        unit[both, 1] = self._entries(prefix, data, cut[both], end[both])
        whole = tail & ~plain
        unit[whole, 0] = self._entries(prefix, data, start[whole], end[whole])
        flat_unit = unit.ravel()
        size = np.where(flat_unit >= 0, self.size[np.maximum(flat_unit, 0)], 0)
        upto = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.start[np.maximum(flat_unit, 0)] - upto[:-1], size) + np.arange(upto[-1])
        return self.flat[place], upto[2 * first]


@functools.lru_cache(maxsize=1)
def worker_tokenizer(path: str) -> PartTokenizer:
    """The tokenizer of this Python worker, kept from task to task."""
    return PartTokenizer(path)


def token_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """One row for each document, or for each part of at most ``max_tokens`` of a longer one; with ``place_col``, its place too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = worker_tokenizer(tokenizer_path)
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            rows: list[int] = []
            docs_, texts = batch.column(0).to_pylist(), batch.column(1)
            for first, last, data, offsets in chunks(texts):
                ids, at_ = tokenizer.ids(data, offsets)
                special = b"<|" in data.tobytes()
                for row in range(last - first):
                    own = ids[at_[row] : at_[row + 1]]
                    if special and b"<|" in (text := data[offsets[row] : offsets[row + 1]].tobytes()):
                        own = tokenizer.tokenizer.encode(text.decode(), add_special_tokens=False).ids
                    own = np.append(own, END_ID).astype("<u4")
                    for k, at in enumerate(range(0, len(own), max_tokens)):
                        part = own[at : at + max_tokens]
                        for column, value in zip(out, (docs_[first + row], k, at, len(part), zlib.crc32(part.tobytes())), strict=True):
                            column.append(value)
                        rows.append(first + row)
            made = [pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            extra = [c.take(pa.array(rows, pa.int64())) for c in batch.columns[2:]]
            yield pa.RecordBatch.from_arrays([*made, *extra], ["doc_id", "piece", "start", "length", "ids_crc32", *batch.schema.names[2:]])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *([F.col(place_col).cast("long").alias("_place")] if place_col else []))
    return own.mapInArrow(run, f"{PIECES}, _place long" if place_col else PIECES)


def must_open(lengths: Sequence[tuple[int, int]], free: int, top: int, max_tokens: int) -> int:
    """Sequences that any packing of documents (length, count) must open beside gaps of ``free`` tokens in all and ``top`` at most."""
    total = sum(length * n for length, n in lengths) - free
    need = -(-total // max_tokens) if total > 0 else 0
    alone = [(length, n) for length, n in lengths if length > top]
    if alone:
        need = max(need, -(-sum(length * n for length, n in alone) // max_tokens))
        # of documents longer than a (k + 1)-th of a sequence, none holds more than k
        for k in range(1, 33):
            need = max(need, -(-sum(n for length, n in alone if length * (k + 1) > max_tokens) // k))
    return need


def sweep(docs: pd.DataFrame, gaps: pd.DataFrame, max_tokens: int) -> pd.DataFrame:
    """One range's superstep: rows of kind ``CLAIM``, of documents left (``DOC``) and of gaps left (``GAP``).

    A claim is (length, first rank, documents per sequence, first sequence, offset of the first of them): from that rank on,
    each run of ``documents per sequence`` ranks lies in the next sequence.
    """
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for room, first, n in gaps.sort_values(["a", "b"], ascending=[True, False])[["a", "b", "n"]].itertuples(index=False):
        held[room].append((first, n))
    sizes = sorted(held)
    rows: list[tuple[int, ...]] = []

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not held[room]:
                bisect.insort(sizes, room)
            held[room].append((first, n))

    for length, rank, left in docs.sort_values(["a", "b"], ascending=[False, True])[["a", "b", "n"]].itertuples(index=False):
        while left and (k := bisect.bisect_left(sizes, length)) < len(sizes):
            room = sizes[k]
            first, n = held[room].pop()
            if not held[room]:
                del sizes[k]
            each = min(room // length, left)
            full = min(n, left // each)
            rows.append((CLAIM, length, rank, full, each, first, max_tokens - room))
            rank, left = rank + full * each, left - full * each
            put(room - each * length, first, full)
            put(room, first + full, n - full)
        if left:
            rows.append((DOC, length, rank, left, 0, 0, 0))
    rows += [(GAP, room, first, n, 0, 0, 0) for room in sizes for first, n in held[room]]
    return pd.DataFrame(rows, columns=["kind", "a", "b", "n", "each", "seq", "offset"]).astype("int64")


def superstep(docs: DataFrame, gaps: DataFrame, tops: Sequence[tuple[int, int]], shares: int, max_tokens: int) -> DataFrame:
    """Runs of ``STATE`` after every range has been swept. tops: (range, largest gap) for each range that has gaps."""
    ranges = F.array(*[F.struct(F.lit(r).alias("range"), F.lit(top).alias("top")) for r, top in tops])
    own = F.floor((F.col("a") - 1) / RANGE)
    successor = F.get(F.filter(ranges, lambda r: (r["range"] >= own) & (r["top"] >= F.col("a"))), 0)["range"].cast("long")
    sent = docs.withColumn("range", successor)
    dealt = sent.where("range is not null").withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    # the remainder of a run goes to other shares for each length
    turn, least, more = F.pmod(F.col("share") + F.col("a"), F.lit(shares)), F.floor(F.col("n") / shares), F.col("n") % shares
    dealt = dealt.withColumn("b", F.col("b") + turn * least + F.least(turn, more)).withColumn("n", least + (turn < more).cast("long")).where("n > 0")
    held = gaps.withColumn("range", own).withColumn("share", F.pmod(F.col("each"), F.lit(shares)).cast("int"))
    keys = ["range", "share"]
    swept = dealt.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(lambda d, g: sweep(d, g, max_tokens), STATE)
    return swept.union(sent.where("range is null").drop("range"))


def claims(counts: DataFrame, max_tokens: int = MAX_TOKENS) -> np.ndarray:
    """Claims that place all documents of (length, count): supersteps until none is left. See :func:`sweep` for the columns."""
    spark = counts.sparkSession
    blank = [F.lit(0).cast("long").alias(c) for c in ("each", "seq", "offset")]
    state = cut(counts.select(F.lit(DOC).cast("long").alias("kind"), F.col("length").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("count").cast("long").alias("n"), *blank))
    found, opened = [], 0
    while True:
        docs, gaps = state.where(F.col("kind") == DOC), state.where(F.col("kind") == GAP)
        waiting = [(r["a"], r["n"]) for r in docs.groupBy("a").agg(F.sum("n").alias("n")).collect()]
        if not waiting:
            break
        if max(waiting)[0] > max_tokens:
            raise ValueError("a piece is longer than a sequence")
        held = gaps.groupBy(F.floor((F.col("a") - 1) / RANGE).alias("range")).agg(F.max("a").alias("top"), F.sum(F.col("a") * F.col("n")).alias("free")).collect()
        tops = {r["range"]: r["top"] for r in held}
        new = must_open(waiting, sum(r["free"] for r in held), max(tops.values(), default=0), max_tokens)
        shares = 1 if tops else min(SHARES, max(1, new // SHARE_SEQUENCES))
        if new:
            edges = [opened + new * k // shares for k in range(shares + 1)]
            fresh = spark.createDataFrame([(GAP, max_tokens, a, b - a, k, 0, 0) for k, (a, b) in enumerate(pairwise(edges))], STATE)
            gaps, opened = gaps.union(fresh), opened + new
            tops[(max_tokens - 1) // RANGE] = max_tokens
        old, state = state, cut(superstep(docs, gaps, sorted(tops.items()), shares, max_tokens))
        discard(old)
        found += [tuple(r) for r in state.where(F.col("kind") == CLAIM).select("a", "b", "each", "seq", "offset").collect()]
    discard(state)
    return np.array(found, dtype=np.int64).reshape(-1, 5)


def best_fit_pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, id_col: str = "doc_id", text_col: str = "text", place_col: str | None = None) -> DataFrame:
    """Pieces with their sequence and the place in it: columns of :func:`token_pieces`, ``sequence_id``, ``offset``.

    place_col: decides between pieces of equal length, and the order of the sequences; nulls come first.
    """
    # written first: sorting by range reads its input twice, and texts are tokenised once
    order = ["_place"] if place_col else []
    pieces = ranked(cut(token_pieces(docs, tokenizer_path, max_tokens, id_col, text_col, place_col)), ["length"], [*order, "doc_id", "piece"])
    plan = claims(pieces.groupBy("length").count(), max_tokens)
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    most = int(plan[:, 1].max(initial=0)) + (1 << 40)
    key = plan[:, 0] * most + plan[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            own = plan[np.searchsorted(key, length * most + rank, side="right") - 1]
            beyond = rank - own[:, 1]
            sequence, offset = own[:, 3] + beyond // own[:, 2], own[:, 4] + beyond % own[:, 2] * length
            own_columns = batch.columns[: 5 + len(order)]
            yield pa.RecordBatch.from_arrays([*own_columns, pa.array(sequence), pa.array(offset)], [*batch.schema.names[: len(own_columns)], "sequence_id", "offset"])

    if not place_col:
        return pieces.mapInArrow(place, f"{PIECES}, sequence_id long, offset long")
    packed = cut(pieces.mapInArrow(place, f"{PIECES}, _place long, sequence_id long, offset long"))
    turns = ranked(packed.groupBy("sequence_id").agg(F.min("_place").alias("_earliest")), [], ["_earliest", "sequence_id"], "_turn")
    return packed.join(turns, "sequence_id").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("_turn").alias("sequence_id"), "offset")
