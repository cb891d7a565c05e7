"""Joins in time: nearest, as-of, point in interval and range joins that never compare every row with every other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _line(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, time: str, tag: str) -> DataFrame:
    """Both sides on one time axis; rows of ``left`` keep all their columns in a struct."""
    a = left.select(*key, F.col(at).alias("_t"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[time].dataType).alias(tag))
    b = right.select(*key, F.col(time).alias("_t"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col(time).alias(tag))
    return a.union(b)


def snap(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, time: str, reach: float | str, out: str = "snapped") -> DataFrame:
    """``left`` with ``out``: the nearest ``time`` of ``right`` if it is at most ``reach``, or the column of that name, away (the earlier of two as near), else ``at`` itself.

    Both sides are sorted once on a common axis, so there is no comparison of pairs; each key's rows meet in one task.
    """
    line = _line(left, right, key, at, time, "_hit")
    # rows of the right come first among equals, so "behind" and "ahead" both see them
    back = Window.partitionBy(*key).orderBy("_t", F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*key).orderBy(F.desc("_t"), F.col("_row").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = line.withColumn("_lo", F.last("_hit", ignorenulls=True).over(back)).withColumn("_hi", F.last("_hit", ignorenulls=True).over(ahead)).where("_row is not null")
    lo, hi, t = F.col("_lo"), F.col("_hi"), F.col("_t")
    near = F.when(lo.isNull() | ((hi - t) < (t - lo)), hi).otherwise(lo)
    most = F.col(f"_row.{reach}") if isinstance(reach, str) else F.lit(reach)
    return both.withColumn("_near", near).select("_row.*", F.when(F.abs(F.col("_near") - t) <= most, F.col("_near")).otherwise(t).alias(out))


def as_of(left: DataFrame, right: DataFrame, key: Sequence[str], at: str, time: str, values: Sequence[str]) -> DataFrame:
    """``left`` with the last non-null of each of ``values`` at or before ``at``."""
    a = left.select(*key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.struct(*left.columns).alias("_row"), *[F.lit(None).cast(right.schema[v].dataType).alias(v) for v in values])
    b = right.select(*key, F.col(time).alias("_t"), F.lit(0).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), *values)
    w = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    line = a.union(b)
    for v in values:
        line = line.withColumn(v, F.last(v, ignorenulls=True).over(w))
    return line.where("_row is not null").select("_row.*", *values)


def in_force(points: DataFrame, spans: DataFrame, key: Sequence[str], at: str, label: str = "label", out: str = "in_force") -> DataFrame:
    """``points`` with the label of the span they lie in: on a boundary the earlier span, before the first the first, behind the last the last. spans: (key, start, end, label), in order and contiguous."""
    # the span in force is the one behind the last end that lies before the point
    w = Window.partitionBy(*key).orderBy("start")
    ends = spans.select(*key, F.col("end").alias("_end"), F.lead(label).over(w).alias("_next"), F.first(label).over(w).alias("_first"))
    first = ends.groupBy(*key).agg(F.min_by("_first", "_end").alias("_start_label"))
    a = points.select(*key, F.col(at).alias("_t"), F.lit(0).alias("_side"), F.struct(*points.columns).alias("_row"), F.lit(None).cast("string").alias("_label"))
    b = ends.where("_next is not null").select(*key, F.col("_end").alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_row"].dataType).alias("_row"), F.col("_next").alias("_label"))
    line = Window.partitionBy(*key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = a.union(b).withColumn("_label", F.last("_label", ignorenulls=True).over(line)).where("_row is not null")
    found = found.select("_row.*", "_label")
    return found.join(first, list(key), "left").select(*points.columns, F.coalesce("_label", "_start_label").alias(out))


def points_inside(spans: DataFrame, points: DataFrame, key: Sequence[str], time: str, width: float) -> DataFrame:
    """Every (span, point) with ``start < time < end``: spans are cut into cells of ``width``, joined on the cell, and tested.

    ``width`` should be about the length of a usual span, so that a span has few cells and a cell few points.
    """
    cell = lambda x: F.floor(x / width)
    cells = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("start")), cell(F.col("end")))))
    other = points.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col(time), cell(F.col(time)).alias("_at"))
    on = F.col("_cell") == F.col("_at")
    for k in key:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return cells.join(other, on).where((F.col("start") < F.col(time)) & (F.col(time) < F.col("end"))).select(*spans.columns, time)


def cut_spans(spans: DataFrame, points: DataFrame, key: Sequence[str], time: str, width: float) -> DataFrame:
    """Spans divided at every point strictly inside them; ``piece`` counts from 0."""
    inside = points_inside(spans, points, key, time, width).groupBy(*spans.columns).agg(F.array_sort(F.collect_set(time)).alias("_cuts"))
    whole = spans.join(inside, list(spans.columns), "left")
    edges = F.concat(F.array("start"), F.coalesce("_cuts", F.array().cast(inside.schema["_cuts"].dataType)), F.array("end"))
    parts = whole.withColumn("_edges", edges)
    parts = parts.select(*[c for c in spans.columns if c not in ("start", "end")], F.posexplode(F.expr("transform(sequence(1, size(_edges) - 1), i -> struct(_edges[i - 1] as a, _edges[i] as b))")).alias("piece", "_p"))
    return parts.select(*[c for c in spans.columns if c not in ("start", "end")], "piece", F.col("_p.a").alias("start"), F.col("_p.b").alias("end")).where("end > start")


def interpolate(points: DataFrame, anchors: DataFrame, key: Sequence[str], at: str, step: str, value: str, default_rate: float, out: str = "value_at") -> DataFrame:
    """Piecewise linear through the anchors; outside them at the median rate between neighbours, or ``default_rate``. anchors: (key, step, value)."""
    w = Window.partitionBy(*key).orderBy(step)
    pairs = anchors.withColumn("_s2", F.lead(step).over(w)).withColumn("_v2", F.lead(value).over(w))
    rates = pairs.groupBy(*key).agg(
        F.median((F.col("_v2") - F.col(value)) / F.greatest(F.col("_s2") - F.col(step), F.lit(1))).alias("_median"),
        F.min(F.struct(step, value)).alias("_first"),
        F.max(F.struct(step, value)).alias("_last"),
    )
    placed = pairs.select(*key, F.col(step).alias("_time"), F.struct(F.col(step).alias("s"), F.col(value).alias("v"), F.col("_s2").alias("s2"), F.col("_v2").alias("v2")).alias("_from"))
    found = as_of(points, placed, key, at, "_time", ["_from"]).join(rates, list(key), "left")
    rate = F.when(F.col("_median") > 0, F.col("_median")).otherwise(F.lit(default_rate))
    x = F.col(at)
    before = F.col(f"_first.{value}") + (x - F.col(f"_first.{step}")) * rate
    after = F.col(f"_last.{value}") + (x - F.col(f"_last.{step}")) * rate
    inner = F.col("_from.v") + (F.col("_from.v2") - F.col("_from.v")) / (F.col("_from.s2") - F.col("_from.s")) * (x - F.col("_from.s"))
    y = F.when(F.col("_first").isNull(), x * default_rate).when(x <= F.col(f"_first.{step}"), before).when(x >= F.col(f"_last.{step}"), after).otherwise(inner)
    return found.select(*points.columns, y.alias(out))


def missing(wanted: DataFrame, have: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``wanted`` without a partner."""
    return wanted.join(have.select(*on).distinct(), list(on), "left_anti")
