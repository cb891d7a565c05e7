"""Ordered passes over groups of any size: rows are cut into cells of an order column, and what crosses a cell is carried by a small table.

The bounds of the cells are quantiles of the whole column, found by one pass before the plan is made; which cell a row belongs
to follows from its value alone. A group that holds a third of all rows spreads over all cells. Rows that share one value
of the order column share a cell. Input that Spark expects to have less than ``SMALL`` bytes, from its sources' sizes and without
running anything, is one cell and takes no pass: a task sorts it as fast.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Cells that a column is cut into, the bytes of input from which it is, and the bytes that a row counts for where rows are counted.
CELLS, SMALL, ROW = 256, 64 << 20, 64
_ORDERED = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)


def expected_bytes(df: DataFrame) -> int:
    """Bytes that Spark's planner expects of ``df``; too many rather than too few where it cannot tell."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def cell_of(df: DataFrame, at: str, cells: int = CELLS) -> Column | None:
    """Number of the cell of each row, nulls first; None where one cell is enough: small input, or columns without quantiles (strings, say)."""
    if not isinstance(df.schema[at].dataType, _ORDERED) or expected_bytes(df) < SMALL:
        return None
    found = df.select(F.percentile_approx(at, [k / cells for k in range(1, cells)], 8 * cells)).first()[0]
    if not found:
        return None
    kind = df.schema[at].dataType
    bounds = sorted(set(found))

    def at_or_behind(low: int, high: int) -> Column:
        """How many bounds a value reaches, by halving; ``low`` to ``high`` are still open."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(F.col(at) < F.lit(bounds[middle]).cast(kind), at_or_behind(low, middle)).otherwise(at_or_behind(middle + 1, high))

    return F.when(F.col(at).isNull(), F.lit(-1)).otherwise(at_or_behind(0, len(bounds)))


def same(left: DataFrame, right: DataFrame, key: Sequence[str], prefix: str) -> Column:
    """Equal keys, nulls equal too; the right one's names begin with ``prefix``."""
    return functools.reduce(Column.__and__, [left[k].eqNullSafe(right[prefix + k]) for k in key], F.lit(True))


def by_length(df: DataFrame, key: Sequence[str], whole: Callable[[DataFrame], DataFrame], cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of the rows of keys that one task may pass through in order, and ``cut`` of those of keys with more than ``SMALL / ROW`` rows.

    One pass before the plan is made counts rows, unless the input is small; only the keys of long groups come to the driver.
    """
    if expected_bytes(df) < SMALL:
        return whole(df)
    found = df.groupBy(*key).count().where(F.col("count") > SMALL // ROW).select(*[F.col(k).alias(f"_k_{k}") for k in key])
    long = found.collect()
    if not long:
        return whole(df)
    named = F.broadcast(df.sparkSession.createDataFrame(long, found.schema))
    on = same(df, named, key, "_k_")
    return whole(df.join(named, on, "left_anti")).union(cut(df.join(named, on, "left_semi")))


def beside(df: DataFrame, table: DataFrame, key: Sequence[str]) -> DataFrame:
    """``df`` with the other columns of ``table``, which has one row for each key."""
    named = table.select(*[F.col(k).alias(f"_k_{k}") for k in key], *[c for c in table.columns if c not in key])
    return df.join(named, same(df, named, key, "_k_")).drop(*[f"_k_{k}" for k in key])


#: What a row learns of its key's cells: the aggregate of the one before (:data:`BEFORE`), the sum up to its own, or its own.
BEFORE, UPTO, OWN = F.lag, F.sum, F.last


def carried(df: DataFrame, key: Sequence[str], order: Sequence[str], inside: dict[str, Column], whole: dict[str, tuple[Column, Callable[[str], Column]]]) -> DataFrame:
    """``df`` with columns over its groups in order.

    inside: window functions within a cell, by name. whole: by name, an aggregate of a cell, and which of its values over the key's
    cells in order a row gets.
    """
    at = cell_of(df, order[0])
    if at is None:
        w, group = Window.partitionBy(*key).orderBy(*order), Window.partitionBy(*key)
        out = df.select("*", *[c.over(w).alias(n) for n, c in inside.items()])
        for n, (agg, over) in whole.items():  # what one cell's window sees
            out = out.withColumn("_c", agg.over(group)).withColumn(n, F.lit(None).cast(out.select(agg.over(group).alias("_c")).schema[0].dataType) if over is BEFORE else F.col("_c")).drop("_c")
        return out
    marked = df.withColumn("_cell", at)
    cell = [*key, "_cell"]
    w = Window.partitionBy(*cell).orderBy(*order)
    out = marked.select("*", *[c.over(w).alias(n) for n, c in inside.items()])
    if whole:
        across = Window.partitionBy(*key).orderBy("_cell")
        sums = marked.groupBy(*cell).agg(*[agg.alias(f"_a_{n}") for n, (agg, _) in whole.items()])
        for n, (_, over) in whole.items():
            sums = sums.withColumn("_c", F.col(f"_a_{n}")).withColumn(n, over("_c").over(across)).drop("_c")
        out = beside(out, sums.select(*cell, *whole), cell)
    return out.drop("_cell")


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], out: str) -> DataFrame:
    """Rows of each key numbered from 1."""
    rows = carried(df, key, order, {"_own": F.row_number()}, {"_upto": (F.count("*"), UPTO), "_here": (F.count("*"), OWN)})
    return rows.withColumn(out, F.col("_own") + F.col("_upto") - F.col("_here")).drop("_own", "_upto", "_here")
