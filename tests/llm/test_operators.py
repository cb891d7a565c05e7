"""Each operator against brute force on small tables with nulls, empty and repeated rows, ties and clashing columns."""

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF, same_rows
from tidemark.llm import hnsw, langid, licenses, linededup, mixing, neardup, packing, quality, queries, store, substrings, suffix, textbytes, vectordup

RNG = np.random.default_rng(11)
VOCAB = ["".join(RNG.choice(list("abcdefghijklmnop"), RNG.integers(2, 9))) for _ in range(400)]


def prose(n, seed):
    return " ".join(np.random.default_rng(seed).choice(VOCAB, n))


def docs_table(spark, texts, extra=True):
    rows = [(i, t, "src%d" % (i % 3), "x", i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string, rank long")
    return df if extra else df.select("doc_id", "text", "source")


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, lang string, score string")


# line dedup


def brute_lines(rows):
    first, gone = {}, defaultdict(set)
    for i, text in sorted((i, t) for i, t in rows if t is not None and i is not None):
        lines = text.split("\n")
        for k in range(len(lines) - 2):
            w = tuple(lines[k : k + 3])
            if any(x.strip(" ") for x in w):
                if first.setdefault(w, (i, k)) != (i, k):
                    gone[i] |= {k, k + 1, k + 2}
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone[i]) for i, t in rows}


def test_line_dedup(spark):
    texts = ["a\nb\nc\nd", "x\na\nb\nc\ny", None, "", "a\nb\nc\nd", "\n\n\n\n", "q\n\n\n\n", "r\nr\nr\nr\nr", "one\ntwo", "b\nc\nd\ne\nf\na\nb\nc"]
    df = docs_table(spark, texts)
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(df).collect()}
    assert got == brute_lines(list(enumerate(texts)))
    clash = df.withColumn("gone", F.lit(1)).withColumn("doc", F.lit(2)).withColumn("n_lines", F.lit("x")).withColumn("a", F.lit(3))
    again = linededup.dedup_lines(clash)
    assert again.columns == [*df.columns, "gone", "doc", "a", "n_lines", "n_removed"] and {r["doc_id"]: r["text"] for r in again.collect()} == got
    assert linededup.dedup_lines(empty(spark)).count() == 0


def test_line_dedup_equals_sql(spark, duck):
    assert same_rows(queries.op9_linededup(spark, SF), duck, queries.OP9_SQL) == 200


# mixing


def test_schedule_deviates_by_less_than_a_block():
    share = mixing.shares({"a": 5, "b": 3, None: 1.3, "tiny": 1e-9}, 100)
    plan = mixing.schedule(share)
    assert sorted(t for slots in plan.values() for t in slots) == list(range(100)) and share["tiny"] == 1
    for slots in plan.values():
        for t in range(101):
            assert abs(sum(s < t for s in slots) - t * len(slots) / 100) < 1


def test_mixing_keeps_every_row(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else "hot" if i % 3 else "b", i) for i in range(500)] + [(1, "hot", 1)], "doc_id long, source string, rank long")
    got = mixing.mix_sources(df, {"hot": 0.5, "b": 0.3, None: 0.2}, block_rows=4, slots=10).toPandas()
    assert len(got) == 501 and not got.duplicated(["slot", "place"]).any()
    blocks = got.drop_duplicates(["slot"])
    for t in range(10, 90, 10):  # until the first source runs out
        taken = blocks[blocks.slot < t].source.fillna("none").value_counts()
        assert abs(taken["hot"] - t * 0.5) < 1 and abs(taken["b"] - t * 0.3) < 1
    clash = df.withColumn("block", F.lit("x")).withColumn("slot", F.lit(1))
    assert mixing.mix_sources(clash, {"hot": 0.5, "b": 0.3, None: 0.2}).columns == ["doc_id", "source", "rank", "block", "slot", "place"]
    assert mixing.mix_sources(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        mixing.mix_sources(df, {"hot": 1.0})


def test_mixing_equals_sql(spark, duck):
    assert same_rows(queries.op3_mixing(spark, SF), duck, queries.OP3_SQL) == 200


@pytest.mark.parametrize(
    "weights, slots",
    [({"a": 0.61234, "b": 0.38721, "c": 0.00045}, 100), ({f"s{i:04}": 1 + i % 7 + 200 * (i == 5) for i in range(1500)}, 1000), ({"a": 2**0.5, None: 3**0.5, "c": 1e-4}, 10)],
)
def test_shares_follow_the_real_weights_over_many_periods(weights, slots):
    names, total = sorted(weights, key=lambda s: (s is not None, s)), sum(weights.values())
    real = np.array([weights[s] / total for s in names])
    period, done = mixing.period_shares(weights, {s: int(np.ceil(200 * slots * weights[s] / total)) for s in names}, slots)
    at = np.arange(len(done))[:, None] * period
    assert len(done) > 200 and (done.sum(axis=1) == at[:, 0]).all() and (np.diff(done, axis=0) >= 0).all()
    assert np.abs(done - at * real).max() < 1 + 1e-6


def test_slots_follow_the_real_weights(spark):
    weights = {"a": 0.61234, "b": 0.38721, "c": 0.00045}
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.expr("case when id < 3600 then 'a' when id < 5900 then 'b' else 'c' end").alias("source"))
    got = mixing.mix_sources(df, weights, block_rows=1, slots=100).toPandas()
    assert len(got) == 6000 and not got.duplicated(["slot"]).any()
    for s, w in weights.items():
        at = np.sort(got.slot[got.source == s].to_numpy())
        k = np.arange(len(at))
        assert np.abs(k - at * w).max() < 2 and np.abs(k + 1 - (at + 1) * w).max() < 2


# packing


def best_fit_decreasing(counts, most):
    """Sequences that best fit needs, longest first, one document at a time."""
    gaps = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            k = bisect.bisect_left(gaps, length)
            gap = gaps.pop(k) if k < len(gaps) else most
            bisect.insort(gaps, gap - length)
    return len(gaps)


def filled(plan, counts, most):
    """Sequences that a plan fills; asserts that every document has its place, gapless and alone."""
    fill = defaultdict(list)
    for length in counts:
        own = plan[plan[:, 0] == length]
        own = own[np.argsort(own[:, 1])]
        for rank in range(counts[length]):
            _, first, each, seq, offset = own[np.searchsorted(own[:, 1], rank, side="right") - 1]
            fill[seq + (rank - first) // each].append((offset + (rank - first) % each * length, length))
    for parts in fill.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= most
    return len(fill)


@pytest.mark.parametrize("case", range(7))
def test_supersteps_pack_like_best_fit(spark, case, monkeypatch):
    rng = np.random.default_rng(case)
    lengths = [
        rng.integers(1, 4097, 3000),
        np.full(5000, 10),
        np.full(999, 1500),
        rng.integers(1900, 2200, 2000),
        np.concatenate([rng.integers(2049, 4097, 500), np.full(6000, 7), np.full(3000, 300)]),
        np.clip(rng.lognormal(6, 1.2, 9000).astype(int), 1, 4096),
        np.array([4096]),
    ][case]
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True)), strict=True))
    table = spark.createDataFrame(list(counts.items()), "length long, count long")
    wanted = best_fit_decreasing(counts, 4096)
    assert filled(packing.claims(table), counts, 4096) <= wanted + 1
    monkeypatch.setattr(packing, "SHARE_SEQUENCES", 100)  # the first superstep in shares, of a hundred documents here
    assert filled(packing.claims(table), counts, 4096) <= wanted * 1.02 + 2


def test_packing_of_nothing_and_of_pieces_too_long(spark):
    assert len(packing.claims(spark.createDataFrame([], "length long, count long"))) == 0
    with pytest.raises(ValueError, match="longer"):
        packing.claims(spark.createDataFrame([(65, 1)], "length long, count long"), 64)


def test_no_packing_opens_less():
    assert packing.must_open([(2049, 10)], 0, 0, 4096) == 10
    assert packing.must_open([(1500, 10)], 0, 0, 4096) == 5
    assert packing.must_open([(100, 10)], 5000, 200, 4096) == 0
    assert packing.must_open([(300, 3)], 5000, 200, 4096) == 1


def test_a_tokenizer_that_joins_words_is_refused(tmp_path):
    import json

    body = json.load(open(queries.tokenizer_path()))
    body["pre_tokenizer"] = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    path = tmp_path / "other.json"
    path.write_text(json.dumps(body))
    with pytest.raises(ValueError, match="parts"):
        packing.PartTokenizer(str(path))


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "It's we'll 3.14, x<|endoftext|> été İstanbul ΑΣ", "same words", "same words", prose(9000, 1), "  \t\x0b ", "日本語。テスト, abc..."] + [prose(k % 50, k) for k in range(60)]
    df = docs_table(spark, texts)
    got = packing.best_fit_pack(df, queries.tokenizer_path()).toPandas()
    tok = Tokenizer.from_file(queries.tokenizer_path())
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        own = got[got.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length[:-1] == 4096).all()
        for p in own.itertuples():
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], dtype="<u4").tobytes()) == p.ids_crc32
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.concatenate([[0], np.cumsum(g.length)[:-1]])).all() and g.length.sum() <= 4096
    assert packing.best_fit_pack(empty(spark), queries.tokenizer_path()).count() == 0


# near duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_near(texts):
    sets = [shingles(t) for t in texts]
    up = list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def edited(text, rate, seed):
    rng = np.random.default_rng(seed)
    return " ".join(w if rng.random() > rate else "z%d" % rng.integers(1000) for w in text.split())


def test_near_duplicates_equal_brute_force(spark):
    base = prose(300, 5)
    texts = [None, "", "  ", "a b c", "A  b\tc", "a b c d", prose(200, 9), prose(200, 9).upper(), prose(200, 9) + " more"]
    texts += [edited(base, 0.03, s) for s in range(120)] + [edited(prose(80, 77), 0.05, s) for s in range(60)]
    df = docs_table(spark, texts)
    got = neardup.near_duplicates(df).toPandas().sort_values("doc_id")
    roots, sizes = brute_near(texts)
    assert got.component_id.tolist() == roots and got.n_shingles.tolist() == sizes
    kept = neardup.drop_near_duplicates(df)
    assert kept.columns == df.columns and kept.count() == len(set(roots))
    again = neardup.near_duplicates(df.union(df)).toPandas()
    assert len(again) == 2 * len(texts) and dict(zip(again.doc_id, again.component_id)) == dict(enumerate(roots))
    assert neardup.near_duplicates(empty(spark)).count() == 0


def test_tiles_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE_ROWS", 16)
    monkeypatch.setattr(neardup, "STARS", 1)
    texts = [edited(prose(200, 5), 0.04, s) for s in range(90)]
    got = neardup.near_duplicates(docs_table(spark, texts)).toPandas().sort_values("doc_id")
    assert got.component_id.tolist() == brute_near(texts)[0]


def test_pruning_keeps_the_threshold():
    least = neardup.needed()
    assert (np.diff(least) > 0).all() and least[-1] < 0.75 * neardup.BANDS * neardup.ROWS


# vectors


def vector_table(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16))
    x[50:90] = x[50] + 0.05 * rng.normal(size=(40, 16))
    x[90:100] = x[3]
    rows = [(int(i), [float(v) for v in np.float32(r)]) for i, r in enumerate(x)]
    odd = [None, [], [0.0] * 16, [float("nan")] + [1.0] * 15, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0]]
    rows += [(300 + k, v) for k, v in enumerate(odd)] + [(None, [1.0] * 16)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("x")), x.astype(np.float32).astype(float)


def test_similar_vectors_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectordup, "LEAF_ROWS", 16)
    monkeypatch.setattr(vectordup, "HOME_ROWS", 8)
    monkeypatch.setattr(vectordup, "VISIT_ROWS", 8)
    df, x = vector_table(spark)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = y @ y.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(x))
    for _ in range(len(x)):
        root = np.minimum(root, np.where(near, root[None], len(x)).min(axis=1))
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectordup.similar_vectors(df).collect()}
    assert len(got) == 308
    for i in range(300):
        assert got[i] == (int(near[i].sum()), int(root[i]))
    assert all(got[k] == (0, k) for k in range(300, 307))
    assert vectordup.similar_vectors(df.limit(0)).count() == 0


def test_pigeonhole_finds_every_close_pair():
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 8)) / 8
    tree = vectordup.median_tree(points, 4)
    budget = 0.02
    row, leaf, own = vectordup.visits(points, tree, budget)
    home = {r: l for r, l, o in zip(row, leaf, own) if l == o}
    seen = defaultdict(set)
    for r, l in zip(row, leaf):
        seen[r].add(l)
    d2 = ((points[:, None] - points[None]) ** 2).sum(axis=2)
    for i, j in zip(*np.nonzero(d2 <= budget)):
        assert home[j] in seen[i] or home[i] in seen[j]


def test_nearest_neighbours(spark):
    df, x = vector_table(spark)
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = hnsw.nearest(df, 5, 50).toPandas()
    hits = 0
    for q in range(0, 300, 50):
        sims = y @ y[q]
        sims[q] = -2
        want = np.lexsort((np.arange(len(x)), -np.round(sims, 9)))[:5]
        own = got[got.query_id == q].sort_values("rank")
        assert own["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(own.score) <= 1e-12).all()
        hits += len(set(own.vec_id) & set(want.tolist()))
        assert np.abs(own.score.to_numpy() - sims[own.vec_id]).max() < 1e-12
    assert hits >= 0.9 * 30
    few = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert hnsw.nearest(few).groupBy("query_id").count().collect()[0]["count"] == 2
    assert hnsw.nearest(df.limit(0)).count() == 0


def test_shards_are_merged(spark, monkeypatch):
    for name, value in {"SHARDS": 4, "SHARD_ROWS": 256, "QUERY_ROWS": 8}.items():
        monkeypatch.setattr(hnsw, name, value)
    x = np.random.default_rng(4).normal(size=(2000, 16)).astype(np.float32).astype(np.float64)
    assert hnsw.shards_of(2000, 16) == 4 and hnsw.shards_of(10**9, 64) == 10**9 // (1 << 18) + 1 and hnsw.shards_of(1, 64) == 1
    df = spark.createDataFrame([(i, v.tolist(), "a") for i, v in enumerate(x)], "vec_id long, embedding array<float>, query_id string")
    got = hnsw.nearest(df).toPandas()
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 2000, 50):
        sims = y @ y[q]
        sims[q] = -2
        own = got[got.query_id == q].sort_values("rank")
        assert np.abs(own.score.to_numpy() - sims[own.vec_id]).max() < 1e-12 and own["rank"].tolist() == [1, 2, 3, 4, 5]
        hits += len(set(own.vec_id) & set(np.argsort(-sims)[:5].tolist()))
    assert hits >= 0.9 * 200


def test_rows_that_share_a_vector_id(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (7, [1.0, 0.1]), (8, [0.2, 1.0]), (0, [1.0, 1.0])]
    got = hnsw.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 3).toPandas()
    own = got[got.query_id == 50]
    assert own.vec_id.tolist() == [8, 0, 7]  # the first by vector asks, and no row of its id is found
    assert (got[got.query_id == 0].vec_id == 50).sum() >= 1


def test_graph_recall():
    x = np.random.default_rng(0).normal(size=(3000, 32))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    found, _ = hnsw.build(x).search(x[::50])
    best = np.argsort(-(x[::50] @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a[:6]) & set(b)) / 6 for a, b in zip(found, best)]) >= 0.9


# substrings


def brute_substrings(texts, length):
    seen = defaultdict(int)
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for k in range(len(b) - length + 1):
            seen[b[k : k + length]] += 1
    out = []
    for b in raw:
        gone = np.zeros(len(b), dtype=bool)
        for k in range(len(b) - length + 1):
            if seen[b[k : k + length]] > 1:
                gone[k : k + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((len(b), int(gone.sum()), int((edge == 1).sum()), np.frombuffer(b, dtype=np.uint8)[~gone].tobytes()))
    return out


@pytest.mark.parametrize("most", [1000, 1])
def test_substrings_equal_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "MOST_CHUNKS", most)
    monkeypatch.setattr(substrings, "WIDTH", 16 if most == 1 else 48)
    passage = prose(60, 1)
    texts = [None, "", "short", passage, "é " + passage + " tail", passage + " x", "y" * 900, prose(100, 2), prose(100, 2)]
    texts += [prose(20, s) + " " + passage[: 150 + 10 * s] + " " + prose(20, 100 + s) for s in range(12)] + [edited(prose(150, 3), 0.03, s) for s in range(8)]
    df = docs_table(spark, texts)
    for length, gram in ((100, 30), (400, 100)):
        got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.dedup_substrings(df, length, gram).collect()}
        assert [got[i] for i in range(len(texts))] == brute_substrings(texts, length)


def test_suffix_arrays_are_built_only_where_strings_differ(spark, monkeypatch):
    """Copies repeat as a whole; arrays are for passages whose surroundings differ. Results equal brute force."""
    given = []
    kept = substrings.by_suffix_arrays

    def spy(strings, shards):
        given.extend(strings.collect())
        return kept(strings, shards)

    monkeypatch.setattr(substrings, "by_suffix_arrays", spy)
    # copies of a whole text, and a passage that others quote
    texts = [prose(160, 21)] * 3 + [prose(60, 22) + prose(90, 23) + prose(60, 24), prose(50, 25) + prose(90, 23) + prose(50, 26), prose(70, 27)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in substrings.dedup_substrings(docs_table(spark, texts), 200, 50).collect()}
    assert [got[i] for i in range(len(texts))] == brute_substrings(texts, 200)
    assert got[0][1] == len(texts[0].encode()) and got[3][1] >= 200 and got[5][1] == 0
    cores = {(r["g"], r["k"], r["core"], r["core2"]) for r in given}
    assert cores and len(given) >= 2 * len(cores)


def test_substrings_of_repeated_rows_and_empty_tables(spark):
    df = docs_table(spark, [prose(100, 4)])
    assert [r["n_removed"] for r in substrings.dedup_substrings(df.union(df)).collect()] == [len(prose(100, 4))] * 2
    assert substrings.dedup_substrings(empty(spark)).count() == 0


def test_long_texts_are_read_in_slices(spark, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK", 500)
    texts = [prose(900, 6) + prose(100, 7), prose(100, 7) + prose(400, 8)]
    got = {r["doc_id"]: bytes(r["kept"]) for r in substrings.dedup_substrings(docs_table(spark, texts), 200, 50).collect()}
    assert [got[i] for i in range(2)] == [b[3] for b in brute_substrings(texts, 200)]


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for _ in range(150):
        s = np.append(rng.integers(1, rng.integers(2, 6), rng.integers(1, 80)), 0)
        sa = suffix.suffix_array(s)
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())
        p = suffix.permuted_prefixes(s, sa, 9)
        for a, b in zip(sa[:-1], sa[1:]):
            n = 0
            while b + n < len(s) and a + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert p[b] == min(n, 9)


# classifiers and licences


def test_quality(spark):
    good = [". ".join(prose(12, 50 * s + k).capitalize() for k in range(6)) + ".\n" + prose(30, s).capitalize() + "." for s in range(150)]
    bad = ["\n".join(" ".join(w + "###" for w in prose(20, 1000 + s).split()) for _ in range(3)) for s in range(75)] + [" ".join([VOCAB[s]] * 60) for s in range(75)]
    df = docs_table(spark, good + bad + [None, "", good[0]])
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    model = quality.train_quality(df, labels)
    got = quality.score_quality(df, model, out_col="q").toPandas().set_index("doc_id")
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([(got.q[i] >= 0.7) == (i < 150) for i in held]) >= 0.95
    assert got.q.between(0, 1).all() and got.q[300] == got.q[301] and got.q[302] == got.q[0]
    assert quality.keep_good(df, model).columns == df.columns
    assert quality.score_quality(df, model).columns.count("score") == 1
    blank = quality.train_quality(df, labels.limit(0))
    assert set(quality.score_quality(df, blank, out_col="q").toPandas().q) == {0.5}
    assert quality.score_quality(empty(spark), model, out_col="q").count() == 0


def test_line_features_do_not_depend_on_the_slice():
    import pyarrow as pa

    texts = ["a b\n\nC!!", "", "x", "Und und und\n", "é"]
    whole = [quality.line_features(d, o) for _, _, d, o in textbytes.chunks(pa.array(texts))]
    single = [quality.line_features(d, o) for _, _, d, o in textbytes.chunks(pa.array(texts), 1)]
    assert np.allclose(whole[0][0], np.vstack([s[0] for s in single]))
    assert np.diff(whole[0][2]).tolist() == [3, 1, 1, 2, 1]


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(2)
    chain = quality.Chain(rng.normal(size=quality.FEATURES) / 4, rng.normal(size=(2, 2)))
    x = rng.normal(size=(7, quality.FEATURES))
    first = np.array([0, 4, 5, 7])
    got, _ = chain.posteriors(x, first)
    for a, b in zip(first[:-1], first[1:]):
        total, mass = 0.0, np.zeros(b - a)
        for code in range(2 ** (b - a)):
            y = [(code >> k) & 1 for k in range(b - a)]
            e = np.exp(sum(y[k] * (x[a + k] @ chain.weights) for k in range(b - a)) + sum(chain.moves[y[k], y[k + 1]] for k in range(b - a - 1)))
            total += e
            mass += e * np.array(y)
        assert np.allclose(got[a:b, 1], mass / total)


def test_language(spark, monkeypatch):
    rng = np.random.default_rng(6)
    alphabets = {"xx": "abcdefgh", "yy": "hijklmnopé", "zz": "äöüqrstuv"}
    rows = [(i, " ".join("".join(rng.choice(list(alphabets[l]), 5)) for _ in range(25)), l) for i, l in enumerate(["xx", "yy", "zz"] * 80)]
    rows += [(900, None, "xx"), (901, "", "yy"), (902, "123 ... !", "zz"), (903, rows[0][1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    model = langid.train_language(df)
    got = langid.predict_language(df, model).toPandas().set_index("doc_id")
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got.lang_pred[i] == rows[i][2] for i in held]) >= 0.95
    assert got.lang_pred[[900, 901, 902]].tolist() == ["und"] * 3 and got.lang_pred[903] == got.lang_pred[0]
    assert got.score.between(0, 1).all()
    monkeypatch.setattr(langid, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.train_language(df)
    nothing = langid.train_language(df.limit(0))
    assert set(langid.predict_language(df, nothing).toPandas().lang_pred) == {"und"}


def test_ftrl_equals_a_plain_version(monkeypatch):
    """One weight at a time, in dictionaries."""
    rng = np.random.default_rng(2)
    samples = []
    for k in range(40):
        at = np.sort(rng.choice(50, 8, replace=False))
        samples.append((k % 3, at, rng.random(8)))
    weights, bias = langid.fit_ftrl(samples, 3)
    z, n = defaultdict(float), defaultdict(float)

    def weight(i, c):
        l1, l2 = (langid.L1, langid.L2) if i < langid.BUCKETS else (0.0, 0.0)
        if abs(z[i, c]) <= l1:
            return 0.0
        return -(z[i, c] - np.sign(z[i, c]) * l1) / ((langid.BETA + n[i, c] ** 0.5) / langid.ALPHA + l2)

    order = np.random.Generator(np.random.PCG64(5))
    for _ in range(langid.EPOCHS):
        for k in order.permutation(len(samples)):
            lang, at, x = samples[k]
            row = [*zip(at.tolist(), x.tolist()), (langid.BUCKETS, 1.0)]
            w = {(i, c): weight(i, c) for i, _ in row for c in range(3)}
            e = [np.exp(sum(v * w[i, c] for i, v in row)) for c in range(3)]
            for i, v in row:
                for c in range(3):
                    g = v * (e[c] / sum(e) - (c == lang))
                    z[i, c] += g - ((n[i, c] + g * g) ** 0.5 - n[i, c] ** 0.5) / langid.ALPHA * w[i, c]
                    n[i, c] += g * g
    for c in range(3):
        assert abs(bias[c] - weight(langid.BUCKETS, c)) < 1e-9
        assert max(abs(weights[i, c] - weight(i, c)) for i in range(50)) < 1e-9
    assert (weights[50:] == 0).all() and (weights[:50] == 0).any()  # L1 leaves weights out


def test_tfidf_and_frequencies_equal_plain_counting(spark):
    texts = ["Ab ba", "ab, AB!", "été", None, "123", "ab " * 50]
    n, df = langid.document_frequencies(docs_table(spark, texts).select("text"))
    grams = [langid.ngram_counts(t or "") for t in texts]
    known = [g for g in grams if g is not None]
    assert n == len(known) == 4 and (df == sum((g > 0).astype(int) for g in known)).all()
    idf = np.log((1 + n) / (1 + df)) + 1
    model = langid.LanguageModel(["x"], idf, np.zeros((langid.BUCKETS, 1)), np.zeros(1))
    at, x = model.tfidf(grams[0])
    plain = {i: (1 + np.log(grams[0][i])) * idf[i] for i in np.flatnonzero(grams[0])}
    norm = sum(v * v for v in plain.values()) ** 0.5
    assert at.tolist() == sorted(plain) and np.allclose(x, [plain[i] / norm for i in at])


def test_scopes_delete_what_is_not_kept(spark):
    with store.scope(spark) as outer:
        with store.scope(spark) as inner:
            a, b = store.cut(spark.range(3)), store.cut(spark.range(4))
            inner.keep(b)
        with pytest.raises(Exception):
            a.count()
        assert b.count() == 4
    with pytest.raises(Exception):
        b.count()
    assert outer.kept == set()


def test_scopes_of_other_threads_are_left_alone(spark):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(1) as other:
        with store.scope(spark):
            theirs = other.submit(lambda: store.cut(spark.range(5).toDF("doc_id"))).result()
            ours = store.cut(spark.range(3).toDF("doc_id"))
        assert theirs.count() == 5
        with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
            ours.count()
        store.discard(theirs)


def test_long_training_texts_are_cut_to_a_stretch(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_LINES", 3)
    texts = ["\n".join(prose(6, 10 * s + k) for k in range(40)) if s % 2 else "\n".join("### $$ 1 2 3" for _ in range(40)) for s in range(60)]
    df = docs_table(spark, texts)
    model = quality.train_quality(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int"))
    got = quality.score_quality(df, model, out_col="q").toPandas()
    assert ((got.q >= 0.7) == (got.doc_id % 2 == 1)).all()


def test_long_texts_have_the_same_ngrams(monkeypatch):
    text = prose(500, 3)
    whole = langid.ngram_counts(text)
    monkeypatch.setattr(langid, "STEP", 100)
    assert (langid.ngram_counts(text) == whole).all()


def test_licences_and_their_inheritance(spark):
    rows = [
        (1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c/file", prose(30, 1)), (3, "a/b/LICENSE", "intro\nReleased under the MIT License."),
        (4, "a/file", "This work is licensed under the GNU General Public License, version 3."), (5, "z/file", prose(30, 2)), (6, None, None), (7, "a/b/d", ""), (8, "a/bc/x", "text"),
        (2, "a/b/c/file", prose(30, 1)),
    ]
    df = spark.createDataFrame(rows, "id long, path string, text string").withColumn("score", F.lit("x"))
    found = licenses.inherit_licenses(licenses.detect_licenses(df), F.col("path").endswith("LICENSE"))
    got = {r["id"]: (r["own_license"], r["license"], r["license_path"]) for r in found.collect()}
    assert found.count() == len(rows)
    assert got[1] == ("Apache-2.0", "Apache-2.0", "a/LICENSE") and got[4][1] == "GPL-3.0"
    assert got[2] == (None, "MIT", "a/b/LICENSE") and got[7] == (None, "MIT", "a/b/LICENSE")
    assert got[8] == (None, "Apache-2.0", "a/LICENSE") and got[5] == (None, None, None) and got[6] == (None, None, None)
    assert licenses.inherit_licenses(licenses.detect_licenses(df.limit(0)), F.lit(True)).count() == 0


# shared pieces


def test_ranks_are_dense_and_ordered(spark):
    df = spark.createDataFrame([("hot" if i % 3 else None, i % 50, i) for i in range(300)], "g string, o long, i long")
    got = store.ranked(df, ["g"], ["o", "i"]).toPandas()
    for _, own in got.groupby("g", dropna=False):
        own = own.sort_values(["o", "i"])
        assert own["rank"].tolist() == list(range(len(own)))


def test_hashes_tell_words_apart():
    import pyarrow as pa

    texts = pa.array(["The cat  sat on the mat", "the CAT sat\ton the mat", "a b", None, ""])
    (_, _, data, offsets), = textbytes.chunks(texts)
    hashes, at = textbytes.shingle_hashes(data, offsets, 5)
    assert np.diff(at).tolist() == [2, 2, 1, 0, 0] and (hashes[:2] == hashes[2:4]).all()
    assert hashlib.sha256(data.tobytes()).hexdigest()


def test_a_notice_on_most_lines_is_found(spark):
    notice = "This work is licensed under a Creative Commons Attribution 4.0 International License"
    df = spark.createDataFrame([(i, f"a/{i}", notice) for i in range(2000)] + [(2000 + i, f"b/{i}", prose(12, i)) for i in range(20)], "id long, path string, text string")
    got = licenses.detect_licenses(df).toPandas().set_index("id")
    assert (got.own_license[:2000] == "CC-BY-4.0").all() and got.score[:2000].min() > 0.999 and got.own_license[2000:].isna().all()


def test_whole_licences_and_wrapped_headers_keep_their_version(spark):
    import textwrap

    full = {name: texts[-1] for name, texts in licenses.license_blocks().items()}
    cases = [(name, text) for name, text in full.items() if name in licenses.LONG]
    for name in ("BSD-2-Clause", "BSD-3-Clause", "MIT"):
        cases += [(name, "Copyright (c) 2020 Ann\n\n" + textwrap.fill(full[name], 60)), (name, full[name].replace("COPYRIGHT HOLDER", "REGENTS").replace("copyright holder", "University"))]
    for name in ("GPL-2.0", "GPL-3.0", "LGPL-3.0", "Apache-2.0", "MPL-2.0"):
        header = licenses.BLOCKS[name][-1]
        cases.append((name, textwrap.fill("Tool, made by Ann. This program " + header, 50, initial_indent=" * ", subsequent_indent=" * ") + "\n" + prose(80, 3)))
    cases += [("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007\n"), ("CC-BY-4.0", f"{prose(60, 4)}. Licensed under CC BY 4.0. {prose(60, 5)}"), ("MIT", f"{prose(200, 6)} released under the\nMIT License {prose(200, 7)}"), (None, prose(300, 8))]
    df = spark.createDataFrame([(i, f"d/{i}", text) for i, (_, text) in enumerate(cases)], "id long, path string, text string")
    got = {r["id"]: (r["own_license"], r["line"]) for r in licenses.detect_licenses(df).collect()}
    assert [got[i][0] for i in range(len(cases))] == [name for name, _ in cases]
    assert got[5][1] == 2 and got[len(cases) - 2][1] == 0


def every_run(matcher, templates, words, least):
    """(cosine, size, begin, name) of the best of all runs of every template's length: cosines of counted words, one run after the other."""
    found = (0.0, 0, 0, None)
    for name in sorted(templates):
        for text in templates[name]:
            own = licenses.terms(text)
            vector = matcher._unit(Counter(own))
            for begin in range(len(words)):
                run = matcher._unit(Counter(words[begin : begin + len(own)]))
                score = round(min(sum(x * vector.get(t, 0.0) for t, x in run.items()), 1.0), 9)
                if score >= least and (score, len(own), -begin) > found[:3]:
                    found = (score, len(own), -begin, name)
    return found


def test_every_run_of_a_text_is_compared(monkeypatch):
    monkeypatch.setattr(licenses, "PLACES", 64)
    rng = np.random.default_rng(12)
    blocks = {name: licenses.BLOCKS[name] for name in ("MIT", "BSD-2-Clause", "BSD-3-Clause", "GPL-3.0", "Apache-2.0")}
    own = licenses.vocabulary(licenses.TEMPLATES) | licenses.vocabulary(blocks)
    df = {t: int(rng.integers(0, 500)) for t in own}
    matcher = licenses.Matcher(blocks | licenses.TEMPLATES, 1000, df)
    words = licenses.Words(own)
    index = licenses.Templates(matcher, blocks, words)
    mit, some = licenses.terms(licenses._MIT), 0
    cases = [mit[45:], ["we", "grant", "you"] + mit[8:], mit[:-20], mit[:60] + ["x", "y"] + mit[60:], prose(200, 1).split(), mit[100:] + mit[:100], [], mit[:1]]
    for name in blocks:
        for text in blocks[name]:
            body = licenses.terms(text)
            for _ in range(4):
                noisy = [w for w in body if rng.random() > 0.04]
                noisy = [w if rng.random() > 0.04 else str(rng.choice(VOCAB)) for w in noisy]
                cases.append([*prose(int(rng.integers(0, 90)), int(rng.integers(99))).split(), *noisy, *prose(int(rng.integers(0, 90)), 7).split()])
    for case in cases:
        score, name, begin = index.best(words.of(" ".join(case)), licenses.BLOCK_LEAST)
        want = every_run(matcher, blocks, case, licenses.BLOCK_LEAST)
        assert (name, begin) == (want[3], -want[2]) and abs(score - want[0]) < 1e-8, " ".join(case)[:80]
        some += name is not None
    assert some > 15


def test_altered_beginnings_and_null_sources(spark):
    mit = licenses._MIT
    words = mit.split()
    texts = [" ".join(words[45:]), mit.replace("Permission is hereby granted, free of charge, to any person obtaining", "We hereby give leave, without fee, to everyone who gets"), "\n".join(words), prose(170, 3), None, "", "x" * 3_000_000 + " \n" * 40_000 + mit]
    df = spark.createDataFrame([(i, t, None if i % 2 else "p") for i, t in enumerate(texts)], "id long, text string, path string")
    got = {r["id"]: (r["own_license"], r["line"]) for r in licenses.detect_licenses(df).collect()}
    assert [got[i][0] for i in range(len(texts))] == ["MIT", "MIT", "MIT", None, None, None, "MIT"] and got[6][1] == 40_000


def test_words_are_numbered_whole_across_pieces(monkeypatch):
    words = licenses.Words({"the", "of"})
    text = "The cat OF the-house  v2.0 of\u3000x " * 30
    whole = words.of(text)
    for piece in (1, 3, 7, 50):
        monkeypatch.setattr(licenses, "PIECE", piece)
        assert (words.of(text) == whole).all()
    assert whole[:4].tolist() == [1, 2, 0, 3]
    monkeypatch.setattr(licenses, "MOST_WORDS", 3)
    assert words.of("of new the").tolist() == [0, 2, 1] and len(words) == 3
