"""Streaming forms of the windows and of the ordered pass, for live series. They extend the batch kernels; on complete data they agree with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def hopping_totals(rows: DataFrame, time: str, key: Sequence[str], value: str, length: str, step: str, late: str) -> DataFrame:
    """(key, start, end, total, n) of every hopping window; rows later than ``late`` behind the newest are left out of a stream. A zoneless time is read in the session's zone."""
    timed = rows.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    sums = timed.groupBy(*key, F.window("_t", length, step).alias("_w")).agg(F.sum(value).alias("total"), F.count("*").alias("n"))
    return sums.select(*key, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "total", "n")


def min_gap_stream(rows: DataFrame, key: str, at: str, gap: float) -> DataFrame:
    """(key, at): rows at least ``gap`` after the last one kept. State is one number for each key; rows must arrive in order across batches."""

    def keep(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        out = []
        for t in sorted(t for part in parts for t in part[at]):
            if last is None or t - last >= gap:
                out.append(t)
                last = t
        if last is not None:
            state.update((last,))
        yield pd.DataFrame({key: [own[0]] * len(out), at: out})

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    made = f"{key} {kinds[key]}, {at} {kinds[at]}"
    return rows.select(key, at).groupBy(key).applyInPandasWithState(keep, made, f"last {kinds[at]}", "append", GroupStateTimeout.NoTimeout)
