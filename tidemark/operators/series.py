"""Kernels over ordered rows: each takes the columns of the series key and of its order, and adds columns or makes rows.

Windows always partition by the series key; the order columns must make the order total for results to be
reproducible.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window, WindowSpec

from tidemark.functions.levels import bin_weight, compressed
from tidemark.operators.cells import BEFORE, beside, by_length, carried, cell_of
from tidemark.operators.summaries import upper_median


def series(key: Sequence[str], order: Sequence[str | Column]) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*order)


def carry_forward(df: DataFrame, key: Sequence[str], order: Sequence[str | Column], value: str | Column, out: str) -> DataFrame:
    """The last value known at each row, its own included."""
    w = series(key, order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))


def label_spans(df: DataFrame, key: Sequence[str], order: Sequence[str], time: str, label: str, end: str | Column) -> DataFrame:
    """(key, start, end, label): each label from its row to the next labelled row, or to ``end``; empty spans go, equal neighbours stay apart."""
    end = F.col(end) if isinstance(end, str) else end
    labelled = df.where(F.col(label).isNotNull()).withColumn("_end", end)
    spans = labelled.select(*key, F.col(time).alias("start"), F.coalesce(F.lead(time).over(series(key, order)), "_end").alias("end"), F.col(label).alias("label"))
    return spans.where(F.col("end") > F.col("start"))


def differences(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """What follows less what is here; null on the last row."""
    return df.withColumn(out, F.lead(value).over(series(key, order)) - F.col(value))


def rises(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, out: str) -> DataFrame:
    """Growth from the row before, falls as 0; the first row grows from 0."""
    return df.withColumn(out, F.greatest(F.col(value) - F.lag(value, 1, 0).over(series(key, order)), F.lit(0)))


def frame(df: DataFrame, key: Sequence[str], order: Sequence[str], agg: Column, before: int, after: int, out: str) -> DataFrame:
    """An aggregate over the rows from ``before`` behind to ``after`` ahead (negative ``after``: strictly behind)."""
    return df.withColumn(out, agg.over(series(key, order).rowsBetween(-before, after)))


def local_peaks(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, peak: tuple[int, int] = (5, 2), mean: tuple[int, int] = (17, 12), delta: float = 0.07) -> DataFrame:
    """Rows above ``delta`` that are the maximum of one frame and exceed the mean of another by ``delta``; edges shorten the frames."""
    w = series(key, order)
    top = F.max(value).over(w.rowsBetween(-peak[0], peak[1]))
    level = F.avg(value).over(w.rowsBetween(-mean[0], mean[1]))
    marked = df.withColumn("_top", top).withColumn("_level", level)
    v = F.col(value)
    return marked.where((v > delta) & (v >= F.col("_top")) & (v >= F.col("_level") + delta)).drop("_top", "_level")


def turning_points(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows above the one before and not below the one behind; never the first or the last row."""
    w = series(key, order)
    both = df.withColumn("_a", F.lag(value).over(w)).withColumn("_b", F.lead(value).over(w))
    return both.where((F.col(value) > F.col("_a")) & (F.col(value) >= F.col("_b"))).drop("_a", "_b")


def last_strong_turn(df: DataFrame, key: Sequence[str], at: str, value: str, share: float = 0.5) -> DataFrame:
    """(key, at): the last turning point that reaches ``share`` of their upper median."""
    tops = turning_points(df, key, [at], value).select(*key, at, value)
    level = upper_median(tops, key, value, "_level")
    return tops.join(level, list(key)).where(F.col(value) >= F.col("_level") * share).groupBy(*key).agg(F.max(at).alias(at))


def magnitude_flux(df: DataFrame, key: Sequence[str], order: Sequence[str], magnitudes: str, frame: int, out: str = "flux") -> DataFrame:
    """Weighted growth of compressed magnitudes from row to row; the first row grows from silence."""
    held = df.withColumn("_level", compressed(F.col(magnitudes), frame))
    level = carried(held, key, order, {"_prior": F.lag("_level")}, {"_last": (F.max_by("_level", F.struct(*order)), BEFORE)})
    before = F.coalesce("_prior", "_last", F.transform("_level", lambda _: F.lit(0.0)))
    grown = F.zip_with("_level", "_before", lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = F.aggregate(F.transform(grown, lambda g, k: g * bin_weight(k)), F.lit(0.0), lambda s, v: s + v)
    return level.withColumn("_before", before).withColumn(out, total).drop("_level", "_prior", "_last", "_before")


def gaussian_weights(deviation: float) -> list[tuple[int, float]]:
    """(offset, weight) of a kernel of three deviations on either side, summing to one."""
    radius = max(1, math.ceil(3 * deviation))
    raw = [(k, math.exp(-0.5 * (k / deviation) ** 2)) for k in range(-radius, radius + 1)]
    total = sum(w for _, w in raw)
    return [(k, w / total) for k, w in raw]


def smooth(df: DataFrame, key: Sequence[str], at: str, value: str, deviation: float, out: str = "smoothed") -> DataFrame:
    """Gaussian smoothing of a series without gaps, as if zeros stood around it: a weighted sum of shifted rows."""
    w = series(key, [at])
    shifted = [F.coalesce(F.lead(value, k).over(w) if k >= 0 else F.lag(value, -k).over(w), F.lit(0.0)) * F.lit(weight) for k, weight in gaussian_weights(deviation)]
    total = shifted[0]
    for s in shifted[1:]:
        total = total + s
    return df.withColumn(out, total)


def _pass(known: DataFrame, key: Sequence[str], at: str, gap: float | str, ties: bool) -> DataFrame:
    """:func:`min_gap` in one pass over sorted partitions, whatever the number of keys; a key is in one task, a batch of rows at a time."""
    new = F.row_number().over(series(key, [at])) == 1
    wide = F.col(gap).cast("double") if isinstance(gap, str) else F.lit(float(gap))
    width, names = len(known.columns), known.columns
    rows = known.select("*", F.col(at).cast("double").alias("_at"), wide.alias("_gap"), new.alias("_new")).sortWithinPartitions(*key, at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = -math.inf
        for batch in batches:
            kept = []
            for t, g, first in zip(*[batch.column(width + i).to_pylist() for i in range(3)], strict=True):
                keep = first or t >= last + g
                if keep:
                    last = t
                kept.append(keep or (ties and t == last))
            yield pa.RecordBatch.from_arrays(batch.columns[:width], names).filter(pa.array(kept, pa.bool_()))

    return rows.mapInArrow(run, known.schema)


def _spaced(rows: pd.DataFrame, at: str, gap: float | str, last: float, ties: bool) -> pd.DataFrame:
    """Rows at least ``gap`` after the one kept before, in the order of ``at``; ``last`` is the one kept before them all."""
    rows = rows.sort_values(at, kind="stable")
    times, wide = rows[at].to_numpy(), float(rows[gap].iloc[0]) if isinstance(gap, str) else gap
    chosen, k = [], 0 if last == -math.inf else int(np.searchsorted(times, last + wide, side="left"))
    while k < len(times):  # from kept row to kept row
        chosen.append(k)
        k = max(k + 1, int(np.searchsorted(times, times[k] + wide, side="left")))
    return rows[np.isin(times, times[chosen])] if ties else rows.iloc[chosen]


def _crossing(times: np.ndarray, gap: float) -> tuple[np.ndarray, np.ndarray]:
    """What a cell makes of the last row kept before it: (from, leaves), a step function.

    If the first row at least ``gap`` after that last one is at ``from[i]`` or later, but not behind ``from[i + 1]``'s step, ``leaves[i]`` is the last row
    kept in the cell. Rows beyond the first ``gap`` of the cell cannot come first, and steps with equal ends are one.
    """
    following = np.maximum(np.searchsorted(times, times + gap, side="left"), np.arange(len(times)) + 1)
    leaves = times.copy()
    for i in range(len(times) - 1, -1, -1):
        if following[i] < len(times):
            leaves[i] = leaves[following[i]]
    first = min(len(times), int(np.searchsorted(times, times[0] + gap, side="left")) + 1)
    turn = np.append(np.flatnonzero(leaves[: first - 1] != leaves[1:first]), first - 1)  # the last row of each step
    return times[turn], leaves[turn]


def min_gap(df: DataFrame, key: Sequence[str], at: str, gap: float | str, ties: bool = False) -> DataFrame:
    """Rows that come at least ``gap`` after the last row kept; a gap that is a column's name is the same for all rows of a key. Rows without a time go.

    With ``ties``, rows at the time of a kept one stay with it; otherwise one of them does. Only series of very many rows are cut into cells.
    """
    known = df.where(F.col(at).isNotNull())
    return by_length(known, key, lambda rows: _pass(rows, key, at, gap, ties), lambda rows: _over_cells(rows, key, at, gap, ties))


def _over_cells(known: DataFrame, key: Sequence[str], at: str, gap: float | str, ties: bool) -> DataFrame:
    """:func:`min_gap` of long series, cut into cells.

    Each cell says where it would end for every place at which the one before it may have ended; along a
    key only these functions are followed, from cell to cell; then every cell is passed through on its own. What crosses is, for
    each cell, at most the rows of its first gap.
    """
    cell = cell_of(known, at)
    if cell is None:
        return _pass(known, key, at, gap, ties)
    marked = known.withColumn("_cell", cell)
    cells = [*key, "_cell"]
    wide = F.col(gap).cast("double") if isinstance(gap, str) else F.lit(float(gap))
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema.fields if f.name in cells)
    slim = marked.select(*cells, F.col(at).cast("double").alias("_at"), wide.alias("_gap"))

    def cross(rows: pd.DataFrame) -> pd.DataFrame:
        froms, leaves = _crossing(np.sort(rows["_at"].to_numpy()), float(rows["_gap"].iloc[0]))
        return pd.DataFrame({**{c: [rows[c].iloc[0]] for c in cells}, "_gap": [float(rows["_gap"].iloc[0])], "_from": [froms], "_leaves": [leaves]})

    def follow(rows: pd.DataFrame) -> pd.DataFrame:
        rows, last, came = rows.sort_values("_cell"), -math.inf, []
        for r in rows.itertuples(index=False):
            came.append(last)
            k = int(np.searchsorted(r._asdict()["froms"], last + r.gap, side="left"))
            last = r.leaves[k] if k < len(r.leaves) else last
        return rows[cells].assign(_last=came)

    crossings = slim.groupBy(*cells).applyInPandas(cross, f"{names}, _gap double, _from array<double>, _leaves array<double>")
    plain = crossings.withColumnsRenamed({"_gap": "gap", "_from": "froms", "_leaves": "leaves"})
    lasts = plain.groupBy(*key).applyInPandas(follow, f"{names}, _last double")
    begun = beside(marked, lasts, cells)
    schema = T.StructType([*marked.schema.fields])
    kept = begun.groupBy(*cells).applyInPandas(lambda rows: _spaced(rows, at, gap, float(rows["_last"].iloc[0]), ties).drop(columns="_last"), schema)
    return kept.drop("_cell")


def thin_labels(df: DataFrame, key: Sequence[str], at: str, label: str, gap: float, ignore: str = "N", ties: bool = False) -> DataFrame:
    """Labels worth drawing: changed from the row before, not ``ignore``, and at least ``gap`` after the last one drawn. Rows without a time go.

    With ``ties``, changed labels at the time of a drawn one are drawn with it.
    """
    changed = lambda rows: rows.where(~F.col(label).eqNullSafe(F.col("_before")) & (F.col(label) != ignore)).select(*df.columns)

    def whole(rows: DataFrame) -> DataFrame:
        return _pass(changed(rows.withColumn("_before", F.lag(label).over(series(key, [at])))), key, at, gap, ties)

    def cut(rows: DataFrame) -> DataFrame:
        held = rows.withColumn("_own", F.struct(F.col(label).alias("label")))
        both = carried(held, key, [at], {"_lag": F.lag("_own")}, {"_last": (F.max_by("_own", at), BEFORE)})
        return _over_cells(changed(both.withColumn("_before", F.coalesce("_lag", "_last")["label"])), key, at, gap, ties)

    return by_length(df.where(F.col(at).isNotNull()), key, whole, cut)


def strong_range(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, share: float = 0.5) -> DataFrame:
    """Rows from the first to the last whose value reaches ``share`` of the series' root mean square."""
    whole = Window.partitionBy(*key)
    numbered = df.withColumn("_i", F.row_number().over(series(key, order))).withColumn("_weak", F.sqrt(F.avg(F.col(value) * F.col(value)).over(whole)) * share)
    strong = F.when(F.col(value) >= F.col("_weak"), F.col("_i"))
    ends = numbered.withColumn("_from", F.min(strong).over(whole)).withColumn("_to", F.max(strong).over(whole))
    return ends.where(F.col("_i").between(F.col("_from"), F.col("_to"))).drop("_i", "_weak", "_from", "_to")


def every_nth_span(df: DataFrame, key: Sequence[str], at: str, n: int) -> DataFrame:
    """(key, bar, start, end): every n-th row from the first to the row n further; bar counts rows from 1."""
    w = series(key, [at])
    rows = df.select(*key, F.row_number().over(w).alias("bar"), F.col(at).alias("start"), F.lead(at, n).over(w).alias("end"))
    return rows.where(((F.col("bar") - 1) % n == 0) & F.col("end").isNotNull())


def phase_strength(df: DataFrame, key: Sequence[str], order: Sequence[str], value: str, phases: int, around: int = 2) -> DataFrame:
    """(key, phase, strength, best): mean over every ``phases``-th row of the maximum around it; the first best phase is marked."""
    w = series(key, order)
    peaks = df.select(*key, ((F.row_number().over(w) - 1) % phases).alias("phase"), F.max(value).over(w.rowsBetween(-around, around)).alias("_top"))
    strength = peaks.groupBy(*key, "phase").agg(F.avg("_top").alias("strength"))
    turn = Window.partitionBy(*key).orderBy(F.desc("strength"), "phase")
    return strength.withColumn("best", F.row_number().over(turn) == 1)


def changed_deciles(df: DataFrame, key: Sequence[str], order: Sequence[str], fraction: str) -> DataFrame:
    """Rows whose tenth of progress differs from that of the row before; no fraction counts as tenth -1."""
    tenth = df.withColumn("decile", F.coalesce(F.floor(F.col(fraction) * 10), F.lit(-1)).cast("int"))
    rows = carried(tenth, key, order, {"_before": F.lag("decile")}, {"_last": (F.max_by("decile", F.struct(*order)), BEFORE)})
    before = F.coalesce("_before", "_last")
    return rows.where(before.isNull() | (before != F.col("decile"))).drop("_before", "_last")


def hit_ends(df: DataFrame, key: Sequence[str], attack: str, preroll: int, longest: int, end: str | Column) -> DataFrame:
    """``hit_start`` and ``hit_end``: from just before the attack to the next start, the series' end or the longest hit."""
    end = F.col(end) if isinstance(end, str) else end
    starts = df.withColumn("hit_start", F.greatest(F.col(attack) - preroll, F.lit(0)))
    return starts.withColumn("hit_end", F.least(F.coalesce(F.lead("hit_start").over(series(key, [attack])), end), F.col(attack) + longest))


def mess_score(df: DataFrame, key: Sequence[str], attack: str, tail_level: str, peak: str, end: str | Column) -> DataFrame:
    """How much a hit is disturbed, in dB: level of what rings on before it against its peak, less 6 for each doubling of the room behind it beyond 50 ms (at most 400)."""
    end = F.col(end) if isinstance(end, str) else end
    room = F.coalesce(F.lead(attack).over(series(key, [attack])), end) - F.col(attack)
    room = F.least(F.greatest(room, F.lit(0.05)), F.lit(0.4))
    ratio = F.greatest(tail_level, F.lit(1e-9)) / F.greatest(peak, F.lit(1e-9))
    return df.withColumn("mess", 20 * F.log10(ratio) - 6 * F.log2(room / 0.05))


def autocorrelation(df: DataFrame, key: Sequence[str], at: str, value: str, lags: range) -> DataFrame:
    """(key, lag, corr): mean product of a centred series, without gaps, with itself ``lag`` rows later, divided by the rows that overlap."""
    whole = Window.partitionBy(*key)
    flat = df.select(*key, F.col(at).alias("_t"), (F.col(value) - F.avg(value).over(whole)).alias("_v"), F.count("*").over(whole).alias("_n"))
    shifted = flat.select(*key, "_n", F.col("_v").alias("_a"), F.col("_t").alias("_from"), F.explode(F.array(*map(F.lit, lags))).alias("lag"))
    other = flat.select(*[F.col(k).alias(f"_k_{k}") for k in key], F.col("_t").alias("_to"), F.col("_v").alias("_b"))
    on = F.col("_from") + F.col("lag") == F.col("_to")
    for k in key:
        on = on & (F.col(k) == F.col(f"_k_{k}"))
    return shifted.join(other, on).groupBy(*key, "lag").agg((F.sum(F.col("_a") * F.col("_b")) / F.first(F.col("_n") - F.col("lag"))).alias("corr"))


def tempo_prior(bpm: Column, centre: float = 120.0) -> Column:
    """Log-normal preference for tempi around ``centre``."""
    return F.exp(-0.5 * F.pow(F.log2(bpm / centre), 2))


def tempo_period(correlations: DataFrame, key: Sequence[str], per_minute: float, lowest: int, octave: float = 0.8) -> DataFrame:
    """(key, period): the lag that the weighted correlation prefers, or one near half of it that correlates nearly as well, refined by a parabola.

    correlations: (key, lag, corr) for every lag from ``lowest`` on; per_minute: rows in a minute.
    """
    one = F.struct("lag", "corr")
    lists = correlations.groupBy(*key).agg(F.array_sort(F.collect_list(one)).alias("cs"))
    weight = lambda c: c["corr"] * tempo_prior(F.lit(per_minute) / c["lag"])
    # the first of the best: largest value, then smallest place
    ranked = F.transform("cs", lambda c, i: F.struct(weight(c).alias("w"), (-i).alias("i")))
    best = lists.withColumn("_top", F.array_max(ranked)).where("_top.w > 0").withColumn("_best", -F.col("_top.i"))
    half = (F.col("_best") + lowest).cast("int") / 2
    around = F.floor(half).cast("int") - lowest
    near = F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.struct(F.get("cs", F.col("_half") + d)["corr"].alias("w"), (-(F.col("_half") + d)).alias("i")))
    halves = best.withColumn("_half", around).withColumn("_fast", F.when((F.col("_half") >= 1) & (F.col("_half") + 1 < F.size("cs")), F.array_max(near)))
    pick = F.when(F.col("_fast.w") >= octave * F.get("cs", F.col("_best"))["corr"], -F.col("_fast.i")).otherwise(F.col("_best"))
    out = halves.withColumn("_at", pick)
    at = lambda d: F.get("cs", F.col("_at") + d)["corr"]
    curve = at(-1) - 2 * at(0) + at(1)
    inner = (F.col("_at") > 0) & (F.col("_at") < F.size("cs") - 1) & (curve < 0)
    return out.select(*key, (F.col("_at") + lowest + F.when(inner, 0.5 * (at(-1) - at(1)) / curve).otherwise(F.lit(0.0))).alias("period"))
