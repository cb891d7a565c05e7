import shutil

import pytest

import corpus_pipeline as P
from tests.conftest import SF


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"file://{tmp_path}/{name}")
        docs = spark.read.parquet(f"file://{tmp_path}/{name}")
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] > 0
    last = P.STAGES[-1][1](spark, docs, SF)
    assert last.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    shutil.rmtree(tmp_path, ignore_errors=True)


DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, slot int, place string, rank double, n_lines string, h string"


def odd_documents(spark):
    """Nulls everywhere, empty, blank and long texts, repeated rows and ids, and columns that clash with the operators' own."""
    same = "one two three four five six seven\nanother line of the text\nand a third line here\n" * 3
    long = "\n".join(f"n{i} " + " ".join(f"w{(i * 31 + k * k) % 997}" for k in range(12)) + "." for i in range(3000))
    texts = [None, "", "   \n ", same, same, same.upper(), long, long + " end", "x", "日本語 テスト\n\n\n"]
    rows = [(i, t, None if i % 4 == 0 else "en", None if i % 3 == 0 else "web", len(t or ""), "s", i, "p", 1.0, "n", None) for i, t in enumerate(texts)]
    rows += [rows[3], rows[6], (None, same, None, None, None, None, None, None, None, None, None), (None, None, None, "web", None, None, None, None, None, None, None), (3, "another text of this id", "en", "web", 1, "s", 1, "p", 1.0, "n", "h")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("name", [name for name, _ in P.STAGES])
def test_stages_take_odd_and_empty_tables(spark, name):
    stage, docs = dict(P.STAGES)[name], odd_documents(spark)
    none = stage(spark, docs.where("false"), SF)
    assert none.count() == 0
    out = stage(spark, docs, SF)
    rows = out.collect()
    if name != "packing":
        assert out.columns == none.columns == docs.columns
    ids = [r["doc_id"] for r in rows]
    n = docs.count()
    if name == "quality":
        assert 0 < len(rows) <= n
    elif name == "lines":
        # of passages, the smallest id's copy stays; rows that share an id lose alike
        texts = [r["text"] for r in rows if r["doc_id"] == 6]
        assert len(texts) == 2 and texts[0] == texts[1] and texts[0].count("\n") == 2999
        assert ids.count(4) == 0 and ids.count(None) == 2 and {0, 1, 2, 8} <= set(ids)
    elif name == "near_duplicates":
        assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 3, 3, 6, 6, 8, 9] and ids.count(None) == 2
    elif name == "mixture":
        assert sorted(map(str, rows)) == sorted(map(str, docs.collect()))
    else:
        assert sum(r["piece"] == 0 for r in rows) == n and sum(r["length"] == 1 for r in rows) >= 3
        places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
        for (s, at, size), (t, then, _) in zip(places, places[1:]):
            assert then == (at + size if s == t else 0)


def test_run_gives_what_the_stages_give(spark):
    assert P.run(spark, SF).count() > 0


def test_the_mixture_decides_the_packed_rows(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sources = [r[0] for r in docs.select("source").distinct().collect()]

    def run(weights):
        monkeypatch.setattr(P, "WEIGHTS", weights)
        return P.packing(spark, P.mixture(spark, docs, SF), SF).toPandas()

    first, other = sorted(sources, key=str)[:2]
    got = {s: run({x: 1.0 if x != s else 1000.0 for x in sources}) for s in (first, other)}
    source = dict(docs.select("doc_id", "source").collect())
    for s, rows in got.items():
        ids = sorted(set(rows.sequence_id))
        assert ids == list(range(len(ids))) and rows.groupby("sequence_id").length.sum().max() <= 4096
        heavy = rows[rows.doc_id.map(source) == s].sequence_id.mean()
        assert heavy < rows[rows.doc_id.map(source) != s].sequence_id.mean()
    one, two = ({(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in rows.itertuples()} for rows in got.values())
    assert one.keys() == two.keys() and one != two
    assert len(set(got[first].sequence_id)) == len(set(got[other].sequence_id))
    again = P.packing(spark, docs.orderBy("n_chars"), SF).toPandas()
    assert {(r.doc_id, r.piece): (r.sequence_id, r.offset) for r in again.itertuples()} == two
