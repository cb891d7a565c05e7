"""Language of a text: sparse multinomial logistic regression on TF-IDF of character n-grams.

Characters are lower-cased, anything but a letter becomes a blank and runs of blanks one blank; n-grams of one to three
characters are hashed into ``BUCKETS`` columns. Document frequencies count every training document, on the executors. The
regression is trained by follow-the-regularised-leader with an elastic net (L1 and L2) on a bounded sample of each
language, and one temperature, fitted on a fifth of that sample that training leaves out, calibrates the probabilities.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows whose language or id is null are not
trained on; ties go to the first language by name; without training rows every text is ``und`` with score 0; an empty
table gives no rows; repeated rows get equal predictions; texts of any length are counted whole, one text in memory at a time;
other columns are not read, whatever their names. The driver holds the sample and a column of weights for each language.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.quality import held_out
from tidemark.llm.store import HASHES, hash_order

BUCKETS = 1 << 14
#: The most training documents of a language: those least by hash of their id.
SAMPLE_PER_LANG = 500
#: Languages that a model may have; more raise an error. So the sample and the weights have a bound, and what is broadcast here too.
MOST_LANGUAGES = 256
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.5
EPOCHS = 3
#: Letters counted at once, so that the memory of a task does not follow the longest text.
STEP = 1 << 18


@functools.cache
def letters() -> np.ndarray:
    """The code point itself where it is a letter, else a blank's."""
    return np.array([k if chr(k).isalpha() else 32 for k in range(0x110000)], dtype=np.uint32)


def ngram_counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams occur; None without a letter."""
    code = letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
    blank = code == 32
    if blank.all():
        return None
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint32)
    out = np.zeros(BUCKETS, dtype=np.int64)
    mul, shift = np.uint32(2654435761), np.uint32(32 - BUCKETS.bit_length() + 1)
    for k in range(0, max(len(code) - 2, 1), STEP):
        c = code[k : k + STEP + 2]
        two = c[:-1] * np.uint32(0x01000193) ^ c[1:]
        three = two[:-1] * np.uint32(0x01000193) ^ c[2:]
        one = c[:STEP]
        for h, salt in ((one, 0x9E37), (two[:STEP], 0x79B9), (three, 0x7F4A)):
            out += np.bincount(((h + np.uint32(salt)) * mul) >> shift, minlength=BUCKETS)
    return out


@dataclass
class LanguageModel:
    names: list[str]
    idf: np.ndarray
    weights: np.ndarray  # (BUCKETS, languages)
    bias: np.ndarray
    temperature: float = 1.0

    def tfidf(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(counts)
        x = (1 + np.log(counts[at])) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def logits(self, counts: np.ndarray) -> np.ndarray:
        at, x = self.tfidf(counts)
        return x @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = ngram_counts(text) if text and self.names else None
        if counts is None:
            return "und", 0.0
        p = softmax(self.logits(counts) / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts with a letter, and in how many of them each bucket occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, dtype=np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                counts = ngram_counts(text.as_py() or "")
                if counts is not None:
                    df += counts > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(df[at], n))], ["bucket", "n"])

    out, n = np.zeros(BUCKETS), 0
    for r in texts.mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        if r["bucket"] < 0:
            n = r["n"]
        else:
            out[r["bucket"]] = r["n"]
    return n, out


def fit_ftrl(samples: list[tuple[int, np.ndarray, np.ndarray]], langs: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by per-coordinate FTRL-proximal; samples of (language, buckets, values). Biases take no penalty."""
    z, n = np.zeros((BUCKETS + 1, langs)), np.zeros((BUCKETS + 1, langs))
    l1 = np.full((BUCKETS + 1, 1), L1)
    l1[-1] = 0

    def weights(at: np.ndarray) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1[at], 0.0, -(zz - np.sign(zz) * l1[at]) / ((BETA + np.sqrt(n[at])) / ALPHA + L2 * (l1[at] > 0)))

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(EPOCHS):
        for k in order.permutation(len(samples)):
            lang, at, x = samples[k]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[lang] -= 1
            g = x[:, None] * p
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) * ALPHA**-1 * w
            n[at] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, by golden section on its logarithm.

    The targets are smoothed by one row of each language, so that a sample without errors does not make it vanish.
    """
    n, langs = logits.shape
    target = np.full(logits.shape, 1 / (n + langs))
    target[np.arange(n), labels] = (n + 1) / (n + langs)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean())

    a, b, g = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def train_language(docs: DataFrame, sample_per_lang: int = SAMPLE_PER_LANG, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> LanguageModel:
    """Learn from the rows outside the held-out ones; the sample has at most ``sample_per_lang`` rows of a language."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    n, df = document_frequencies(known.select(text_col))
    idf = np.log((1 + n) / (1 + df)) + 1
    ids = known.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang")).withColumn("_order", hash_order("_id"))
    # what lies far beyond a language's first rows is left out before they are ranked
    counts = ids.groupBy("_lang").agg(F.count("*").alias("_n"))
    if counts.limit(MOST_LANGUAGES + 1).count() > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; the model has weights for each")
    near = ids.join(F.broadcast(counts), "_lang").where(F.col("_order") < F.least(F.lit(1.0), (2 * sample_per_lang + 1000) / F.col("_n")) * HASHES)
    turn = Window.partitionBy("_lang").orderBy("_order", "_id")
    ids = near.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= sample_per_lang).select("_id", "_lang").distinct()
    chosen = docs.select(F.col(id_col).alias("_id"), F.col(lang_col).alias("_lang"), F.col(text_col).alias("_text")).join(F.broadcast(ids), ["_id", "_lang"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = ngram_counts(text.as_py() or "")
                if counts is not None:
                    at = np.flatnonzero(counts)
                    rows.append((doc, lang, at.astype("<u2").tobytes(), counts[at].astype("<u4").tobytes()))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.binary(), pa.binary()), strict=True)], ["doc", "lang", "at", "n"])

    rows = sorted(chosen.select(F.col("_id").cast("long"), "_lang", "_text").mapInArrow(run, "doc long, lang string, at binary, n binary").collect())
    names = sorted({r["lang"] for r in rows})
    model = LanguageModel(names, idf, np.zeros((BUCKETS, len(names))), np.zeros(len(names)))
    samples = []
    for r in rows:
        counts = np.zeros(BUCKETS, dtype=np.int64)
        counts[np.frombuffer(r["at"], dtype="<u2")] = np.frombuffer(r["n"], dtype="<u4")
        samples.append((names.index(r["lang"]), *model.tfidf(counts)))
    train, check = [s for k, s in enumerate(samples) if k % 5], samples[::5]
    if names:
        model.weights, model.bias = fit_ftrl(train or samples, len(names))
        model.temperature = fit_temperature(np.array([x @ model.weights[at] + model.bias for _, at, x in check]), np.array([s[0] for s in check]))
    return model


def predict_language(docs: DataFrame, model: LanguageModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
