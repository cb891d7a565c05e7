import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", str(tmp_path_factory.mktemp("local")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def same_rows(frame, con, sql):
    """Columns and rows of a query and of its SQL, floats to six places and with the sign of their zeros."""

    def norm(v):
        if isinstance(v, float):
            return repr(round(v, 6))
        return [norm(x) for x in v] if isinstance(v, (list, tuple)) else None if v is None else str(v)

    found = con.execute(sql)
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(frame.columns)
    order = sorted(names)
    a = sorted(([norm(r[c]) for c in order] for r in frame.collect()), key=repr)
    b = sorted(([norm(r[names.index(c)]) for c in order] for r in found.fetchall()), key=repr)
    assert a == b
    return len(a)
