"""Hopping windows: plans, expansion of rows into windows, weighted overlap-add."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class WindowPlan:
    """What a window reads, what of its result counts, where its prefix ends, and how far into it generation goes (None: to its end)."""

    start: float
    end: float
    accept_start: float
    accept_end: float
    prefix_end: float
    stop: float | None


def plan_windows(duration: float, length: float = 300.0, overlap: float = 200.0, lookahead: float = 100.0) -> list[WindowPlan]:
    """Windows of ``length`` that overlap, the last one ending at ``duration``; each but the last is believed up to its lookahead."""
    last = max(0.0, duration - length)
    hop = length - overlap
    starts = [k * hop for k in range(math.ceil(last / hop))] + [last] if last > 0 else [0.0]
    plans, accepted = [], 0.0
    for k, start in enumerate(starts):
        final = k == len(starts) - 1
        end = min(duration, start + length)
        until = duration if final else end - lookahead
        plans.append(WindowPlan(start, end, accepted, until, accepted, None if final else length - lookahead))
        accepted = until
    return plans


def window_table(durations: DataFrame, key: Sequence[str], duration: str, length: float = 300.0, overlap: float = 200.0, lookahead: float = 100.0) -> DataFrame:
    """The same plan for every series of a table: (key, window_no, start, end, accept_start, accept_end)."""
    hop, d = length - overlap, F.col(duration)
    last = F.greatest(d - length, F.lit(0.0))
    n = F.ceil(last / hop).cast("int")
    rows = durations.select(*key, d.alias("_d"), last.alias("_last"), n.alias("_n"), F.explode(F.sequence(F.lit(0), n)).alias("window_no"))
    start = F.when(F.col("window_no") == F.col("_n"), F.col("_last")).otherwise(F.col("window_no") * F.lit(hop))
    end = F.least(F.col("_d"), F.col("start") + length)
    until = F.when(F.col("window_no") == F.col("_n"), F.col("_d")).otherwise(F.col("end") - lookahead)
    before = F.when(F.col("window_no") == 0, F.lit(0.0)).otherwise((F.col("window_no") - 1) * F.lit(hop) + length - lookahead)
    return rows.withColumn("start", start).withColumn("end", end).withColumn("accept_end", until).select(*key, "window_no", "start", "end", before.alias("accept_start"), "accept_end")


def accepted(df: DataFrame, time: str, start: str, end: str, duration: str, slack: float = 1e-4) -> DataFrame:
    """Rows of a window's result that count: from its accept bounds, both moved ``slack`` earlier, and before the end of the series."""
    t = F.col(time)
    return df.where((t >= F.col(start) - slack) & (t < F.col(end) - slack) & (t < F.col(duration) - slack))


def into_windows(df: DataFrame, at: str, length: int, step: int, last: str | Column | None = None) -> DataFrame:
    """Each row once for every window [k * step, k * step + length) that holds it: ``window_start`` and ``offset`` in it."""
    t = F.col(at)
    first = F.greatest(F.floor((t - length) / step) + 1, F.lit(0))
    rows = df.withColumn("window_start", F.explode(F.sequence(first, F.floor(t / step)))).withColumn("window_start", F.col("window_start") * step)
    return rows.withColumn("offset", t - F.col("window_start"))


def triangle(offset: Column, length: int) -> Column:
    """Weights that rise to the middle of a segment and fall behind it, never zero."""
    half = length // 2
    return F.when(offset < half, offset + 1).otherwise(length - offset).cast("double") / half


def faded(offset: Column, length: int, fade: int, start: Column, final: Column) -> Column:
    """1 with linear ramps of ``fade`` rows at both ends; none at the start of the first window or the end of the final one."""
    rise = F.when((offset < fade) & (start > 0), offset.cast("double") / (fade - 1 if fade > 1 else 1)).otherwise(F.lit(1.0))
    fall = F.when((length - 1 - offset < fade) & ~final, (length - 1 - offset).cast("double") / (fade - 1 if fade > 1 else 1)).otherwise(F.lit(1.0))
    return rise * fall


def overlap_add(parts: DataFrame, key: Sequence[str], at: str, value: str | Column, weight: str | Column, out: str = "value") -> DataFrame:
    """Weighted mean of what the windows say about each place."""
    v, w = (F.col(c) if isinstance(c, str) else c for c in (value, weight))
    return parts.groupBy(*key, at).agg((F.sum(v * w) / F.greatest(F.sum(w), F.lit(1e-8))).alias(out))
