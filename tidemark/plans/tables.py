"""Cutting a plan's lineage in loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """``df`` as a checkpoint in ``spark.checkpoint.dir``, which all executors share. Without that setting, in local mode only, in a temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        root = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not context.master.startswith("local") or "local-cluster" in context.master:
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = tempfile.mkdtemp(prefix="tidemark-")
        context.setCheckpointDir(root)
    return df.checkpoint()
