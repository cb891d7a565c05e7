import numpy as np
import pytest

from tests.conftest import SF, same_rows
from tidemark.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    assert same_rows(QUERIES[name](spark, SF), duck, SQL[name]) > 0


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_similarity_groups_equal_brute_force(spark):
    from tests.test_series import brute_groups

    rows = sorted(QUERIES["similarity_groups"](spark, SF).collect(), key=lambda r: r["vec_id"])
    vectors = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    assert [r["vec_id"] for r in rows] == sorted(vectors)
    for label in {r["label"] for r in rows}:
        own = [r for r in rows if r["label"] == label]
        groups = brute_groups([vectors[r["vec_id"]] for r in own], 0.15)
        assert [r["group_id"] for r in own] == [next(k for k, g in enumerate(groups) if i in g) for i in range(len(own))]


def test_many_groups_equal_sql(spark, duck):
    from tidemark.operators.similarity import similarity_groups
    from tidemark.plans.queries import groups_sql

    rows = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "label", "embedding")
    got = similarity_groups(rows, ["label"], "vec_id", "embedding", 0.14).select("vec_id", "label", "group_id")
    assert got.distinct().select("label", "group_id").distinct().count() > 100
    assert same_rows(got, duck, groups_sql(0.14)) == 500


def test_scans_prune_and_push_down(spark):
    plan = QUERIES["accept_filter"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_quantity" in plan and "l_shipdate" not in plan


def test_grammar_steps_beyond_the_vocabulary_equal_sql(spark, tmp_path):
    import duckdb

    # parts of 13 leave each class of tokens; suppliers' numbers beyond 31,160 lead out of the vocabulary
    rows = [(k, part, supplier, line) for k, supplier in enumerate((3, 30_500, 31_160, 31_161, 59_999, None)) for line, part in enumerate((0, 12, 0, 12, 12, 0, 7, 0, 8, 9, None, 0, 1), 1)]
    rows += [(9, 12, 5, None), (9, 0, 40_000, 1), (9, None, 40_000, 1)]
    df = spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert same_rows(QUERIES["grammar_steps"](spark, str(tmp_path)), con, SQL["grammar_steps"]) == len(rows)


def test_label_thinning_equals_sql_with_ties_and_nulls(spark, tmp_path):
    import datetime as dt

    import duckdb

    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    said = [(1, None, "a"), (1, 0, "a"), (1, 2, "b"), (1, 7, "c"), (1, 7, "d"), (1, 9, "a"), (1, 13, "b"), (1, 20, "error"), (1, 21, None), (1, 22, "b"), (None, 1, "a"), (2, 5, "error")]
    df = spark.createDataFrame([(i, at(h), user, kind, 1.0) for i, (user, h, kind) in enumerate(said)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    df.write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert same_rows(QUERIES["label_thinning"](spark, str(tmp_path)), con, SQL["label_thinning"]) == 5
