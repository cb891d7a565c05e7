"""Bounded-space online packing: every task packs the documents it reads into windows of which it holds a few open.

Nothing is sorted or shuffled to pack: documents are taken in the order in which a partition has them, and a task holds at most ``OPEN`` windows.

1. A document of a window or more fills windows of its own; what is left of it, or a shorter document, is placed.
2. It goes into the open window that it leaves least room in (best fit). If none has room, a new one is opened; if ``OPEN`` are open, the
   fullest is emitted first. The document's beginning fills it to the last token, so no emitted window has padding, and its rest is placed anew.
3. At its end a task leaves at most ``OPEN`` windows. They are merged by the same rule: the windows of ``FAN`` tasks are one task's input, which
   leaves ``OPEN`` again, so after a round for each factor of ``FAN`` one set is left. A merge's input does not grow with the table.
4. The last set is packed full, window after window, but for one; that one is cut into lengths that are powers of two, which need no padding.

Every document is tokenised once. Emitted pieces and open ones are rows of one table in the shared folder (``ids`` as little-endian unsigned
32-bit numbers), which the merges read: a lost executor costs a part of one step.

Defined cases: a null text is an empty one, which has the closing id alone; texts of any length are tokenised whole; rows that repeat a doc_id
are packed each on its own; a null doc_id is kept; other columns are not read, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.bytetokens import worker_byte_tokenizer
from tidemark.llm.store import cut
from tidemark.llm.textbytes import chunks

WINDOW, END_ID = 2048, 1
#: Open windows of a task, and tasks whose open windows are merged by one.
OPEN, FAN = 32, 16

#: Pieces; sequence_id is null in windows that are still open, ``task`` numbers who holds them, ``window_no`` tells a task's apart.
PIECES = "doc_id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long, task long, window_no int"
_TYPES = [pa.int64()] * 4 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32()]
_NAMES = [c.split()[0] for c in PIECES.split(", ")]

#: (doc_id, start, doc_tokens, ids): a run of a document's tokens.
Run = tuple[int | None, int, int, np.ndarray]


class Windows:
    """The open windows of one task. Emitted ones are numbered from ``number``."""

    def __init__(self, number: int, task: int, size: int = WINDOW, most: int = OPEN):
        self.number, self.task, self.size, self.most = number, task, size, most
        self.rooms: list[tuple[int, int]] = []  # (room, key), sorted
        self.runs: dict[int, list[Run]] = {}
        self.keys = 0
        self.out: list[tuple] = []

    def _emit(self, runs: list[Run], window: int | None = None) -> None:
        """Rows of a window: emitted, or still open if it has a number among the open ones."""
        at = 0
        for doc, start, whole, ids in runs:
            self.out.append((doc, start, len(ids), whole, ids.tobytes(), self.number if window is None else None, at, self.task, window))
            at += len(ids)
        self.number += window is None

    def _put(self, at: int, run: Run) -> None:
        """A run into the open window at a place of ``rooms``; a window that is full is emitted."""
        room, key = self.rooms.pop(at)
        self.runs[key].append(run)
        if room == len(run[3]):
            self._emit(self.runs.pop(key))
        else:
            bisect.insort(self.rooms, (room - len(run[3]), key))

    def place(self, run: Run) -> None:
        doc, start, whole, ids = run
        while len(ids) >= self.size:
            self._emit([(doc, start, whole, ids[: self.size])])
            start, ids = start + self.size, ids[self.size :]
        while len(ids):
            at = bisect.bisect_left(self.rooms, (len(ids), -1))
            if at == len(self.rooms):
                if len(self.rooms) == self.most:  # the fullest is emitted, full
                    room = self.rooms[0][0]
                    self._put(0, (doc, start, whole, ids[:room]))
                    start, ids = start + room, ids[room:]
                    continue
                self.keys += 1
                self.runs[self.keys] = []
                at = bisect.bisect_left(self.rooms, (self.size, self.keys))
                self.rooms.insert(at, (self.size, self.keys))
            self._put(at, (doc, start, whole, ids))
            return

    def leave(self) -> None:
        """Rows of the windows that are still open."""
        for k, (_, key) in enumerate(self.rooms):
            self._emit(self.runs[key], k)

    def finish(self) -> None:
        """Emits what is open: full windows, and powers of two."""
        runs = [run for _, key in self.rooms for run in self.runs[key]]
        left = sum(len(run[3]) for run in runs)
        self.rooms, self.runs = [], {}
        while left:
            take = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= take
            some: list[Run] = []
            while take:
                doc, start, whole, ids = runs.pop(0)
                some.append((doc, start, whole, ids[:take]))
                if len(ids) > take:
                    runs.insert(0, (doc, start + take, whole, ids[take:]))
                take -= min(take, len(ids))
            self._emit(some)

    def rows(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def pack_partitions(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """``PIECES`` of the documents as each partition packs them, open windows among them. docs: (doc_id, text)."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, task = worker_byte_tokenizer(tokenizer_path), TaskContext.get().partitionId()
        windows = Windows(task << 36, task, window, most)
        for batch in batches:
            names = batch.column(0).to_pylist()
            for first, last, data, offsets in chunks(batch.column(1)):
                ids, at = tokenizer.ids(data, offsets)
                special = b"<|" in data.tobytes()
                for row in range(last - first):
                    own = ids[at[row] : at[row + 1]]
                    if special and b"<|" in (text := data[offsets[row] : offsets[row + 1]].tobytes()):
                        own = tokenizer.tokenizer.encode(text.decode(), add_special_tokens=False).ids
                    own = np.append(own, END_ID).astype("<u4")
                    windows.place((names[first + row], 0, len(own), own))
                if len(windows.out) >= 512:
                    yield batch_of(windows.rows())
        windows.leave()
        if rows := windows.rows():
            yield batch_of(rows)

    return docs.mapInArrow(run, PIECES)


def merge(open_: DataFrame, first: int, last: bool, fan: int = FAN, window: int = WINDOW, most: int = OPEN) -> DataFrame:
    """``PIECES`` after the open windows of every ``fan`` tasks were merged; ``last``: one set is left, which is emitted. Numbers begin at ``first``."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        group = int(key[0])
        windows = Windows(first + (group << 36), group, window, most)
        for r in rows.sort_values(["task", "window_no", "offset"]).itertuples(index=False):
            windows.place((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.doc_tokens, np.frombuffer(r.ids, dtype="<u4")))
        if last:
            windows.finish()
        else:
            windows.leave()
        made = pd.DataFrame(windows.rows(), columns=_NAMES)
        return made.astype({c: "Int64" for c in ("doc_id", "sequence_id", "window_no")})

    return open_.groupBy(F.floor(F.col("task") / fan).alias("group")).applyInPandas(run, PIECES)


def online_pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, most: int = OPEN, fan: int = FAN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, length, doc_tokens, ids, sequence_id, offset): pieces of documents in sequences of ``window`` tokens, or of a power of two.

    ``start`` counts the document's tokens before the piece, ``offset`` the sequence's. ``window`` itself is a power of two.
    """
    if window & (window - 1):
        raise ValueError("a window is a power of two of tokens")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    made = cut(pack_partitions(own, tokenizer_path, window, most))
    emitted, open_ = made.where("sequence_id is not null"), made.where("sequence_id is null")
    tasks = (open_.agg(F.max("task")).first()[0] or 0) + 1
    first = 0
    while True:
        first, last = first + (tasks << 36), tasks <= fan
        step = cut(merge(open_, first, last, fan, window, most))
        emitted = emitted.unionByName(step.where("sequence_id is not null"))
        if last:
            break
        open_, tasks = step.where("sequence_id is null"), -(-tasks // fan)
    return emitted.drop("task", "window_no")
