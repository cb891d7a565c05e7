"""Aggregates with the tie-breaks and medians that time-series summaries need."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.cells import OWN, UPTO, beside, carried, numbered


def dominant(df: DataFrame, key: Sequence[str], label: str, weight: Column | None = None, out: str = "label") -> DataFrame:
    """(key, out, weight): the label with the largest sum of ``weight`` (count of rows, without), the smallest label of several."""
    total = (F.count("*") if weight is None else F.sum(weight)).alias("weight")
    sums = df.where(F.col(label).isNotNull()).groupBy(*key, F.col(label).alias(out)).agg(total)
    turn = Window.partitionBy(*key).orderBy(F.desc("weight"), out)
    return sums.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") == 1).drop("_turn")


def true_median(df: DataFrame, key: Sequence[str], value: str | Column, out: str = "median") -> DataFrame:
    """The middle value, or the mean of the middle two."""
    return df.groupBy(*key).agg(F.median(value).alias(out))


def upper_median(df: DataFrame, key: Sequence[str], value: str, out: str = "upper_median") -> DataFrame:
    """The middle value, or the upper of the middle two, by ranks instead of a list of all values."""
    known = df.where(F.col(value).isNotNull()).select(*key, value)
    ranked = beside(numbered(known, key, [value], "_i"), known.groupBy(*key).agg(F.count("*").alias("_n")), key)
    return ranked.where(F.col("_i") == F.floor(F.col("_n") / 2) + 1).select(*key, F.col(value).alias(out))


def tempo(df: DataFrame, key: Sequence[str], time: str, unit: str | None = None, out: str = "bpm") -> DataFrame:
    """Median of 60 / gap over consecutive rows; with ``unit`` (a note value's denominator) in quarter notes. Gaps of zero do not count."""
    gap = F.lead(time).over(Window.partitionBy(*key).orderBy(time)) - F.col(time)
    rate = 60 / F.col("_gap") * (F.lit(4) / F.col(unit) if unit else F.lit(1))
    return df.withColumn("_gap", gap).where(F.col("_gap") > 0).groupBy(*key).agg(F.median(rate).alias(out))


def mean_tempo(df: DataFrame, key: Sequence[str], at: str, rate: float, out: str = "bpm") -> DataFrame:
    """60 * rate * (rows - 1) / span; null for a single row."""
    span = F.max(at) - F.min(at)
    return df.groupBy(*key).agg((F.when(span > 0, F.lit(60.0) * rate * (F.count("*") - 1) / span)).alias(out))


def levels(df: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """peak, rms, mean and energy of each series."""
    v = F.col(value)
    return df.groupBy(*key).agg(F.max(F.abs(v)).alias("peak"), F.sqrt(F.avg(v * v)).alias("rms"), F.avg(v).alias("mean"), F.sum(v * v).alias("energy"))


def decibels(level: Column, floor: float = 1e-12, power: bool = False) -> Column:
    return (10 if power else 20) * F.log10(F.greatest(level, F.lit(floor)))


def sdr(df: DataFrame, key: Sequence[str], reference: str | Column, estimate: str | Column, out: str = "sdr") -> DataFrame:
    """Signal-to-distortion ratio in dB over all rows of a key."""
    s = F.col(reference) if isinstance(reference, str) else reference
    e = F.col(estimate) if isinstance(estimate, str) else estimate
    return df.groupBy(*key).agg((10 * F.log10(F.sum(s * s) / F.greatest(F.sum((s - e) * (s - e)), F.lit(1e-20)))).alias(out))


def having_unless_none(groups: DataFrame, size: str, fewest: int, key: Sequence[str] = ()) -> DataFrame:
    """Groups of at least ``fewest``, or all of a key if it has none."""
    top = groups.groupBy(*key).agg(F.max(size).alias("_top"))
    both = beside(groups, top, key) if key else groups.crossJoin(F.broadcast(top))
    return both.where((F.col(size) >= fewest) | (F.col("_top") < fewest)).drop("_top")


def standardise(df: DataFrame, key: Sequence[str], value: str, out: str = "z") -> DataFrame:
    """(value - mean) / (1e-5 + unbiased deviation) within each series, both aggregated before they meet the rows."""
    both = df.groupBy(*key).agg(F.avg(value).alias("_mean"), F.stddev_samp(value).alias("_deviation"))
    return beside(df, both, key).withColumn(out, (F.col(value) - F.col("_mean")) / (F.lit(1e-5) + F.col("_deviation"))).drop("_mean", "_deviation")


def nearest_half(df: DataFrame, key: Sequence[str], distance: str, tie: str) -> DataFrame:
    """The (n + 1) div 2 rows of each key with the least distance."""
    ranked = beside(numbered(df, key, [distance, tie], "_i"), df.groupBy(*key).agg(F.count("*").alias("_n")), key)
    return ranked.where(F.col("_i") <= F.floor((F.col("_n") + 1) / 2)).drop("_i", "_n")


def first_extreme(df: DataFrame, key: Sequence[str], score: str, ordinal: str, largest: bool = False) -> DataFrame:
    """The row with the least (or largest) score of each key, the first of several."""
    s = -F.col(score) if largest else F.col(score)
    names = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min(F.struct(s.alias("_s"), F.col(ordinal).alias("_o"), *names)).alias("_r")).select(*key, *[F.col(f"_r.{c}").alias(c) for c in names])


def running_share(df: DataFrame, key: Sequence[str], order: Sequence[str], amount: str, out: str = "done") -> DataFrame:
    """Sum up to each row over the sum of all."""
    own = F.sum(amount)
    rows = carried(df, key, order, {"_own": own}, {"_upto": (own, UPTO), "_here": (own, OWN)})
    total = df.groupBy(*key).agg(own.alias("_all"))
    none = F.lit(0)
    upto = F.coalesce("_upto", none) - F.coalesce("_here", none) + F.coalesce("_own", none)
    return beside(rows, total, key).withColumn(out, upto / F.col("_all")).drop("_own", "_upto", "_here", "_all")


def last_rows(df: DataFrame, key: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key."""
    turn = Window.partitionBy(*key).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_turn", F.row_number().over(turn)).where(F.col("_turn") <= n).drop("_turn")
