"""Coverage reports as JSON: a list of files, each with how many of its lines were run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT = "files array<struct<path string, covered long, total long>>"


def covered_files(reports: DataFrame, key: Sequence[str], json: str) -> DataFrame:
    """(key, path, covered, total): each file of a key's reports once, that with the most lines. Text that is no report gives no rows."""
    each = reports.select(*key, F.explode(F.from_json(json, REPORT)["files"]).alias("_f"))
    best = each.groupBy(*key, F.col("_f.path").alias("path")).agg(F.max(F.struct("_f.total", "_f.covered")).alias("_m"))
    return best.select(*key, "path", F.col("_m.covered").alias("covered"), F.col("_m.total").alias("total"))


def coverage(reports: DataFrame, key: Sequence[str], json: str) -> DataFrame:
    """(key, files, covered, total, share) over all files of a key's reports."""
    sums = covered_files(reports, key, json).groupBy(*key).agg(F.count("*").alias("files"), F.sum("covered").alias("covered"), F.sum("total").alias("total"))
    return sums.withColumn("share", F.when(F.col("total") > 0, F.col("covered") / F.col("total")))
