"""Tab-separated annotation files: no header, a time first."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "beat": "time double, number int, numerator int, denominator int",
    "downbeat": "time double",
    "key": "start double, end double, label string",
    "chord": "start double, end double, label string",
    "structure": "start double, end double, label string",
}


def read_lab(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[kind]).option("sep", "\t").option("quote", "").csv(path)


def excerpt(rows: DataFrame, time: str, start: float, seconds: float) -> DataFrame:
    """Rows whose time lies in ``[start, start + seconds)``, that time counted from ``start``."""
    return rows.where((F.col(time) >= start) & (F.col(time) < start + seconds)).withColumn(time, F.col(time) - start)


def lab_text(rows: DataFrame, key: list[str], order: list[str], columns: list[str], out: str = "text") -> DataFrame:
    """One text for each key: a line for each row in order, fields between tabs, a line end behind every line.

    A key's rows are gathered to make its file, so a key should be one song.
    """
    line = F.concat_ws("\t", *[F.col(c).cast("string") for c in columns])
    listed = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*order, line.alias("_line")))).alias("_l"))
    return listed.select(*key, F.concat(F.array_join(F.transform("_l", lambda r: r["_line"]), "\n"), F.lit("\n")).alias(out))
