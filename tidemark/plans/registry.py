"""Where queries register, and the views of the driver's tables that several of them read."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Time in microseconds and in seconds, and hourly totals of each event type without gaps, for the queries below.
EVENTS_SQL = "ev AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) AS us, epoch_us(ts) / 1e6 AS s FROM events)"
HOURLY_SQL = """hours AS (SELECT event_type, (epoch_us(ts) // 3600000000) AS h, sum(value) AS v FROM events GROUP BY ALL),
lim AS (SELECT event_type, min(h) AS lo, max(h) AS hi FROM hours GROUP BY event_type),
grid AS (SELECT event_type, lo, unnest(range(lo, hi + 1)) AS h FROM lim),
hourly AS (SELECT g.event_type, g.h - g.lo AS t, coalesce(o.v, 0.0) AS v FROM grid g LEFT JOIN hours o USING (event_type, h))"""


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", us.alias("us"), (us / 1e6).alias("s"))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_type, t, v): totals of each hour from the first one of a type to its last."""
    rows = events(spark, sf_dir).groupBy("event_type", F.floor(F.col("us") / 3_600_000_000).alias("h")).agg(F.sum("value").alias("v"))
    ends = rows.groupBy("event_type").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    grid = ends.select("event_type", "lo", F.explode(F.sequence("lo", "hi")).alias("h"))
    return grid.join(rows, ["event_type", "h"], "left").select("event_type", (F.col("h") - F.col("lo")).alias("t"), F.coalesce("v", F.lit(0.0)).alias("v"))


def r6(c: str) -> F.Column:
    return F.round(c, 6).alias(c)
