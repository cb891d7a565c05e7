"""Inventories of model files: what a run needs, what is missing, how far a download is."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.joins import missing
from tidemark.operators.summaries import running_share

MODEL_FILE = "repo string, revision string, folder string, path string, bytes long"


def needed(spark: SparkSession, registry: Sequence[tuple], extra: Sequence[tuple] = (), with_extra: bool = False) -> DataFrame:
    """Files of the registry, and of the extra one if it is asked for."""
    own = spark.createDataFrame(list(registry), MODEL_FILE)
    return own.unionByName(spark.createDataFrame(list(extra), MODEL_FILE)) if with_extra else own


def pending(wanted: DataFrame, have: DataFrame) -> DataFrame:
    """Files that are not there yet, with the share of all bytes that is done once each has come."""
    return running_share(missing(wanted, have, ["folder", "path"]), [], ["folder", "path"], "bytes")
