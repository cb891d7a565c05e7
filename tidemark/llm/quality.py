"""Document quality from a linear-chain conditional random field over the lines of a text.

Every line is good or bad. Its features are shares of byte classes, repetition of words, word length and line ends, and the
same of the line before and the line after. The field is fitted by maximum conditional likelihood with an L2 penalty on
a bounded sample of labelled documents, whose lines all take the document's label; forward-backward marginals of
P(good), weighted by line length, make the document's quality, and a logistic calibration fitted on the sample turns it into
the score.

Defined cases: a null or empty text is one empty line and gets that line's score; a label that is null is not used; a document
with several labels counts as bad if one of them is; without any labels every score is 0.5; an empty table gives no rows;
repeated rows score alike; texts of any length are scored whole (for training, a sampled document of more than
``SAMPLE_LINES`` lines gives that many in a row, from a place by hash of its id, so the driver's memory is bounded); other
columns pass through, but for one with the name of the score, which it replaces.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.store import least_by_hash
from tidemark.llm.textbytes import chunks, prefix_hash, span_hash, words

#: The most labelled documents that the field is fitted on: those least by hash of their id.
SAMPLE_DOCS = 3000
#: The most lines of each of them.
SAMPLE_LINES = 256
KEEP_FROM = 0.7
EPOCHS = 60
L2 = 1e-3

_CLASS = np.full(256, 7, dtype=np.int64)
for _k, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"0123456789", b" \t\r\x0b\x0c\n", b".,;:?'\"-", b"!", b"|<>[]{}()/\\_=~^`")):
    _CLASS[list(_chars)] = _k
_CLASSES = 8
LOCAL = 14
FEATURES = 3 * LOCAL + 3


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its length in bytes plus one, and the offsets of each text's own lines."""
    ends = np.flatnonzero(data == 10)
    # a line starts at each text and behind each line feed; an empty text has one empty line
    docs = len(offsets) - 1
    start = np.concatenate([offsets[:-1], ends + 1])
    owner = np.concatenate([np.arange(docs), np.searchsorted(offsets, ends, side="right") - 1])
    order = np.lexsort((np.concatenate([np.full(docs, -1), ends]), owner))
    start, owner = start[order], owner[order]
    stop = np.empty(len(start), dtype=np.int64)
    stop[:-1] = np.where(owner[1:] == owner[:-1], start[1:] - 1, offsets[owner[:-1] + 1])
    if len(start):
        stop[-1] = offsets[-1]
    first = np.searchsorted(owner, np.arange(docs + 1))
    n = len(start)
    size = stop - start
    line_of = np.repeat(np.arange(n), size + np.append((owner[1:] == owner[:-1]).astype(np.int64), 0) if n else size)
    count = np.bincount(line_of * _CLASSES + _CLASS[data], minlength=n * _CLASSES).reshape(n, _CLASSES).astype(np.float64) if len(data) else np.zeros((n, _CLASSES))
    w_start, w_end, _ = words(data, offsets)
    per_line = np.searchsorted(w_start, np.append(start, offsets[-1])) if n else np.zeros(1, np.int64)
    n_words = np.diff(per_line).astype(np.float64)
    hashes = span_hash(prefix_hash(data), w_start, w_end)
    same = np.zeros(len(hashes) + 1)
    if len(hashes) > 1:
        again = np.zeros(len(hashes))
        again[1:] = hashes[1:] == hashes[:-1]
        starts = per_line[:-1][n_words > 0]
        again[starts] = 0
        np.cumsum(again, out=same[1:])
    repeated = same[per_line[1:]] - same[per_line[:-1]]
    chars = np.maximum(size, 1)
    w = np.maximum(n_words, 1)
    last = np.where(size > 0, data[np.maximum(stop - 1, 0)] if len(data) else 0, 0)
    head = np.where(size > 0, data[np.minimum(start, max(len(data) - 1, 0))] if len(data) else 0, 0)
    local = np.column_stack([
        count[:, 0] / np.maximum(count[:, 0] + count[:, 1], 1),
        count[:, 2] / chars,
        count[:, 4] / w,
        count[:, 5] / w,
        count[:, 6] / w,
        count[:, 7] / w,
        repeated / w,
        np.minimum((count[:, 0] + count[:, 1]) / w, 30) / 10,
        np.log1p(n_words) / 5,
        n_words < 3,
        np.isin(last, list(b".!?\"'")),
        (head >= 65) & (head <= 90),
        size == 0,
        repeated > 0.3 * w,
    ])
    before, after = np.zeros_like(local), np.zeros_like(local)
    begins, finishes = np.zeros(n), np.zeros(n)
    if n:
        inner = owner[1:] == owner[:-1]
        before[1:][inner] = local[:-1][inner]
        after[:-1][inner] = local[1:][inner]
        begins[first[:-1]], finishes[first[1:] - 1] = 1, 1
    return np.column_stack([np.ones(n), local, before, after, begins, finishes]), size + 1.0, first


@dataclass
class Chain:
    """A field of two states (0 bad, 1 good): weights of state 1, transition scores, calibration."""

    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    slope: float = 1.0
    shift: float = 0.0

    def posteriors(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(state) of every line, and expected moves summed over all sequences, by forward-backward over all texts at once."""
        score = np.zeros((len(x), 2))
        score[:, 1] = x @ self.weights
        score = np.exp(score - score.max(axis=1, keepdims=True))
        move = np.exp(self.moves)
        length = np.diff(first)
        order = np.argsort(-length, kind="stable")
        begin, sizes = first[:-1][order], length[order]
        longest = int(sizes[0]) if len(sizes) else 0
        active = [int(np.searchsorted(-sizes, -t, side="left")) for t in range(longest + 1)]  # texts of more than t lines
        ahead, back = np.empty_like(score), np.ones_like(score)
        for t in range(longest):
            at = begin[: active[t]] + t
            now = score[at] if t == 0 else (ahead[at - 1] @ move) * score[at]
            ahead[at] = now / now.sum(axis=1, keepdims=True)
        moved = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            at = begin[: active[t + 1]] + t
            coming = score[at + 1] * back[at + 1]
            pair = ahead[at][:, :, None] * move[None] * coming[:, None, :]
            moved += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
            now = coming @ move.T
            back[at] = now / now.sum(axis=1, keepdims=True)
        p = ahead * back
        return p / p.sum(axis=1, keepdims=True), moved

    def quality(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Length-weighted mean of P(good) of each text's lines."""
        p = self.posteriors(x, first)[0][:, 1]
        total = np.concatenate([[0.0], np.cumsum(p * size)])
        weight = np.concatenate([[0.0], np.cumsum(size)])
        return (total[first[1:]] - total[first[:-1]]) / np.maximum(weight[first[1:]] - weight[first[:-1]], 1)

    def score(self, x: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * _logit(self.quality(x, size, first)) + self.shift)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def _logit(q: np.ndarray) -> np.ndarray:
    q = np.clip(q, 1e-4, 1 - 1e-4)
    return np.log(q / (1 - q))


def fit_chain(x: np.ndarray, size: np.ndarray, first: np.ndarray, labels: np.ndarray) -> Chain:
    """Adam on the conditional log-likelihood, each document with the weight of one; then the calibration by Newton steps."""
    chain = Chain()
    if not len(labels):
        return chain
    length = np.diff(first)
    y = np.repeat(labels, length).astype(np.float64)
    both = np.zeros((2, 2))
    for k in (0, 1):
        both[k, k] = (length[labels == k] - 1).sum()
    n = len(y)
    theta = np.zeros(FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, EPOCHS + 1):
        chain.weights, chain.moves = theta[:FEATURES], theta[FEATURES:].reshape(2, 2)
        p, moved = chain.posteriors(x, first)
        grad = np.concatenate([x.T @ (y - p[:, 1]), (both - moved).ravel()]) / n - L2 * theta
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta = theta + 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    chain.weights, chain.moves = theta[:FEATURES].copy(), theta[FEATURES:].reshape(2, 2).copy()
    z = _logit(chain.quality(x, size, first))
    design = np.column_stack([z, np.ones_like(z)])
    beta = np.array([1.0, 0.0])
    for _ in range(25):
        p = _sigmoid(design @ beta)
        hess = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta + np.linalg.solve(hess, design.T @ (labels - p) - 1e-2 * (beta - [1.0, 0.0]))
    chain.slope, chain.shift = float(max(beta[0], 1e-3)), float(beta[1])
    return chain


def held_out(id_col: str = "doc_id"):
    """Rows that no model is fitted on: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train_quality(docs: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """Fit on at most ``sample_docs`` labelled documents outside the held-out ones. labels: (id, quality)."""
    known = labels.where(F.col("quality").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("_id")).agg(F.min("quality").alias("_label"))
    known = least_by_hash(known, ["_id"], sample_docs)
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(known), "_id").select("_label", "_text", F.crc32(F.col("_id").cast("string").cast("binary")).alias("_turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in chunks(batch.column(1)):
                x, size, first = line_features(data, offsets)
                count = np.diff(first)
                begin = first[:-1] + batch.column(2)[a:b].to_numpy() % np.maximum(count - SAMPLE_LINES + 1, 1)
                rows = [(x[i:j].astype("<f4").tobytes(), size[i:j].astype("<f4").tobytes()) for i, j in zip(begin, begin + np.minimum(count, SAMPLE_LINES), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.int32()), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary())], ["label", "x", "size"])

    rows = sorted(chosen.mapInArrow(run, "label int, x binary, size binary").collect(), key=lambda r: (r["label"], r["x"]))
    x = np.frombuffer(b"".join(r["x"] for r in rows), dtype="<f4").reshape(-1, FEATURES).astype(np.float64)
    size = np.frombuffer(b"".join(r["size"] for r in rows), dtype="<f4").astype(np.float64)
    first = np.concatenate([[0], np.cumsum([len(r["size"]) // 4 for r in rows])]).astype(np.int64)
    return fit_chain(x, size, first, np.array([r["label"] for r in rows], dtype=np.int64))


def score_quality(docs: DataFrame, model: Chain, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each text, from 0 to 1; a column of that name is replaced."""
    docs = docs.drop(out_col)
    place = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.score(*line_features(data, offsets)) for _, _, data, offsets in chunks(batch.column(place))]
            score = np.concatenate(made) if made else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, out_col])

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, model: Chain, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches ``KEEP_FROM``."""
    return score_quality(docs, model, text_col, "_score").where(F.col("_score") >= KEEP_FROM).drop("_score")
