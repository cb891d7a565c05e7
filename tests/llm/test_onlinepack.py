"""Online packing: a round trip through the tokenizer, no padding, bounded open windows; parts of texts against the whole tokenizer."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.conftest import SF
from tidemark.llm import bytetokens, onlinepack, queries

WORDS = "it's they'll we've don't 'tis x'y 3.14 a_b ... !? é 日本語 🙂 <|endoftext|> <| naïve THE of".split(" ")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer_path("byte_bpe_50k.json"))


def check(rows, texts, tokenizer, window=onlinepack.WINDOW, repeats=1):
    """rows: (doc_id, start, length, crc, doc_tokens, sequence_id, offset). Every id once, gapless sequences, no padding."""
    docs, sequences, cuts = defaultdict(list), defaultdict(list), 0
    for doc, start, length, crc, whole, sequence, offset in rows:
        docs[doc].append((start, length, crc, whole))
        sequences[sequence].append((offset, length))
    assert set(docs) == set(texts)
    for doc, pieces in docs.items():
        ids = np.array([*tokenizer.encode(texts[doc] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for start, length, crc, whole in sorted(pieces)[::repeats]:
            assert start == at and length > 0 and whole == len(ids)
            assert crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)
        cuts += len(pieces) - 1
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window and at & (at - 1) == 0
    return len(sequences), cuts


def test_parts_equal_the_whole_tokenizer(tokenizer):
    own = bytetokens.ByteTokenizer(queries.tokenizer_path("byte_bpe_50k.json"))
    rng = random.Random(9)
    letters = "ab'sStmdrevl  \n\t\r1²é!.-日 \u0085​x🙂"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(4000)] + ["", " ", "'s", "''s"]
    data = [np.frombuffer(t.encode(), dtype=np.uint8) for t in texts]
    ids, at = own.ids(np.concatenate(data), np.concatenate([[0], np.cumsum([len(d) for d in data])]))
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)


def test_another_kind_of_tokenizer_is_refused():
    with pytest.raises(ValueError):
        bytetokens.ByteTokenizer(queries.tokenizer_path("word_bpe_49k.json"))


def packed(df, **more):
    from pyspark.sql import functions as F

    out = onlinepack.online_pack(df, queries.tokenizer_path("byte_bpe_50k.json"), **more)
    return [tuple(r) for r in out.select("doc_id", "start", "length", F.crc32("ids"), "doc_tokens", "sequence_id", "offset").collect()]


@pytest.mark.parametrize("window, most, fan, parts", [(2048, 32, 16, 3), (64, 4, 2, 7), (16, 1, 2, 5), (256, 8, 3, 40)])
def test_every_token_is_packed_once(spark, tokenizer, window, most, fan, parts):
    rng = random.Random(window)
    texts = {i: " ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 1, 5, 30, 200, 900]))) for i in range(150)} | {150: None, 151: "", 152: "word " * 9000, None: "no id"}
    df = spark.createDataFrame([(i, t, "x", i) for i, t in texts.items()], "doc_id long, text string, ids string, start long").repartition(parts)
    rows = packed(df, window=window, most=most, fan=fan)
    check(rows, texts, tokenizer, window)
    assert rows == [*{r[:4] + r[5:]: r for r in rows}.values()]
    tokens = sum(r[2] for r in rows)
    # all are full but what one last window held
    assert len({r[5] for r in rows}) <= tokens // window + window.bit_length()


def test_repeated_rows_and_nothing(spark, tokenizer):
    df = spark.createDataFrame([(1, "a b c"), (2, None)], "doc_id long, text string")
    check(packed(df.union(df)), {1: "a b c", 2: None}, tokenizer, repeats=2)
    assert packed(df.where("doc_id > 5")) == []
    with pytest.raises(ValueError):
        onlinepack.online_pack(df, "", window=1000)


def test_few_windows_are_open_and_the_best_fit_is_taken():
    windows = onlinepack.Windows(0, 0, size=16, most=2)
    run = lambda doc, n: (doc, 0, n, np.zeros(n, dtype="<u4"))
    windows.place(run(1, 9))
    windows.place(run(2, 12))
    windows.place(run(3, 3))  # beside 2
    assert windows.rooms == [(1, 2), (7, 1)]
    windows.place(run(4, 8))  # fits nowhere: its first token fills the fullest, the rest fits the other
    assert [(r[0], r[1], r[2], r[5], r[6]) for r in windows.rows()] == [(2, 0, 12, 0, 0), (3, 0, 3, 0, 12), (4, 0, 1, 0, 15), (1, 0, 9, 1, 0), (4, 1, 7, 1, 9)]
    rng = random.Random(1)
    for k in range(500):
        windows.place(run(k, rng.randint(1, 40)))
        assert len(windows.rooms) <= 2 and sorted(windows.rooms) == windows.rooms


def test_query(spark, tokenizer):
    texts = {r["doc_id"]: r["text"] for r in queries.table(spark, SF, "documents").collect()}
    out = queries.op12_windows(spark, SF)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    check([tuple(r) for r in out.collect()], texts, tokenizer)
