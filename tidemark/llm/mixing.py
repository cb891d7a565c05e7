"""Interleave sources by target weights: Pfair release times and deadlines, earliest deadline first.

Each source's rows are numbered in order and cut into blocks, of which one goes in each slot. Slots are dealt in two
levels. Each period of ``slots`` slots is shared out in whole blocks: block j of a source with weight w is released in
the period of slot j / w and due by the end of that of (j + 1) / w, and the released blocks with the earliest deadlines
fill the period, so at the end of every period, however many there are, a source deviates from its weight by less
than one block. Inside a period with n blocks of a source the same rule runs slot by slot with the weight n / slots, so
anywhere else the deviation is less than two blocks. Weights are whole numbers of 2^-40, so they count as given up to 10^12 slots.

The driver shares out the periods (sources x periods numbers, at most ``MOST_SHARES``: for larger tables periods have
more slots); executors make the schedules of the periods that their rows fall in. A source that runs out leaves its slots
empty; no row is dropped. A weight so small that its source's rows need more than ``MOST_PERIOD`` slots in each period raises.

Defined cases: null is a source of its own; rows with one doc_id keep their own places, in any order among them; an
empty table gives no rows; texts are not read; other columns pass through, but for columns named ``block``, ``slot`` or ``place``,
which the result's own replace. More than ``MOST_SOURCES`` sources raise an error: give a column of classes of sources
instead, with the sums of their weights, and mix each class by itself.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.store import ranked

BLOCK_ROWS = 16
SLOTS = 1000
#: Weights of sources that get no target go with the number of rows to this power.
SMOOTHING = 0.5
#: More sources than this do not fit a schedule held on the driver.
MOST_SOURCES = 10_000
#: Sources times periods that the driver shares out, and slots of a period.
MOST_SHARES = 1 << 21
MOST_PERIOD = 1 << 20
#: Weights are whole numbers of this part of their sum.
UNIT = 1 << 40


def shares(weights: Mapping[str | None, float], slots: int) -> dict[str | None, int]:
    """Whole slots of each source by largest remainder, at least one each; ties go to the earlier name."""
    names = sorted(weights, key=lambda s: (s is not None, s))
    if not names:
        return {}
    if any(weights[s] <= 0 for s in names):
        raise ValueError("target weights must be positive")
    slots = max(slots, len(names))
    total, spare = sum(weights.values()), slots - len(names)
    exact = [max(0.0, weights[s] / total * slots - 1) for s in names]
    scale = spare / sum(exact) if sum(exact) else 0.0
    exact = [x * scale for x in exact]
    got = [int(x) for x in exact]
    for k in sorted(range(len(names)), key=lambda k: (got[k] - exact[k], k))[: spare - sum(got)]:
        got[k] += 1
    return {s: g + 1 for s, g in zip(names, got, strict=True)}


def schedule(share: Mapping[str | None, int]) -> dict[str | None, list[int]]:
    """The slots of each source within a period; ties of deadlines go to the earlier name."""
    names = sorted(share, key=lambda s: (s is not None, s))
    period = sum(share.values())
    release: list[list[tuple[int, int, int]]] = [[] for _ in range(period)]
    for i, s in enumerate(names):
        n = share[s]
        for j in range(n):
            release[j * period // n].append((-(-(j + 1) * period // n), i, j))
    out: dict[str | None, list[int]] = {s: [0] * share[s] for s in names}
    ready: list[tuple[int, int, int]] = []
    for t in range(period):
        for block in release[t]:
            heapq.heappush(ready, block)
        due, i, j = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a deadline was missed")
        out[names[i]][j] = t
    return out


def whole_weights(weights: Mapping[str | None, float]) -> np.ndarray:
    """Weights as whole numbers with the sum ``UNIT``, at least one each, in the order of names."""
    names = sorted(weights, key=lambda s: (s is not None, s))
    if any(not 0 < weights[s] < math.inf for s in names):
        raise ValueError("target weights must be positive")
    total = math.fsum(weights.values())
    out = np.array([max(1, round(weights[s] / total * UNIT)) for s in names], dtype=np.int64)
    if len(out):
        out[out.argmax()] += UNIT - out.sum()
    return out


def period_shares(weights: Mapping[str | None, float], blocks: Mapping[str | None, int], slots: int) -> tuple[int, np.ndarray]:
    """Slots of a period, and how many blocks of each source (a column, in the order of names) go before each period.

    The last row has all ``blocks``. The first period has the shares of :func:`shares` if no source has less than a slot of it.
    """
    names = sorted(weights, key=lambda s: (s is not None, s))
    unit = whole_weights(weights)
    need = np.array([blocks.get(s, 0) for s in names], dtype=np.int64)
    if not need.any():
        return slots, np.zeros((1, len(names)), dtype=np.int64)
    last = max(-(-int(n) * UNIT // int(w)) for n, w in zip(need, unit, strict=True))
    most = max(MOST_SHARES // len(names), 2)
    slots *= max(1, -(-last // (slots * most)))
    if slots > MOST_PERIOD:
        raise ValueError("a target weight is too small for the rows of its source")
    done = [np.zeros(len(names), dtype=np.int64)]
    behind = np.zeros(len(names), dtype=np.int64)  # weight times slots so far less blocks so far, in units
    while (done[-1] < need).any():
        behind = behind + unit * slots
        got = np.maximum(behind // UNIT, 0)  # due in this period
        if len(done) == 1 and (unit * slots >= UNIT).all():
            got = np.array(list(shares(weights, slots).values()), dtype=np.int64)
        left = behind - got * UNIT
        spare = slots - int(got.sum())
        if spare:
            due = np.where(left > 0, -(-(UNIT - left) // (unit * slots)), np.iinfo(np.int64).max)
            got[np.lexsort((-left, due))[:spare]] += 1
        behind = behind - got * UNIT
        done.append(done[-1] + got)
    return slots, np.array(done)


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str | None, float] | None = None,
    block_rows: int = BLOCK_ROWS,
    slots: int = SLOTS,
    source_col: str = "source",
    order_col: str = "doc_id",
) -> DataFrame:
    """``docs`` with ``block`` (within its source), ``slot`` and ``place`` (in the block).

    Sorting by (slot, place) gives the mixture. Without ``weights``, a source weighs its rows to the power
    ``SMOOTHING``; a source that ``weights`` lacks raises ValueError.
    """
    spark = docs.sparkSession
    docs = docs.drop("block", "slot", "place")
    rows = {r[0]: r[1] for r in docs.groupBy(source_col).count().limit(MOST_SOURCES + 1).collect()}
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    if weights is None:
        weights = {s: n**SMOOTHING for s, n in rows.items()}
    if missing := [s for s in rows if s not in weights]:
        raise ValueError(f"no target weight for source {missing[0]!r}")
    names = sorted(weights, key=lambda s: (s is not None, s))
    period, done = period_shares(weights, {s: -(-n // block_rows) for s, n in rows.items()}, slots)
    table = spark.createDataFrame(list(zip(names, range(len(names)), strict=True)), "_source string, _index int")
    place = ranked(docs, [source_col], [order_col], "_rank").withColumn("block", F.floor(F.col("_rank") / block_rows))
    known: dict[bytes, dict[int, np.ndarray]] = {}

    def run(index: pd.Series, block: pd.Series) -> pd.Series:
        out = np.zeros(len(index), dtype=np.int64)
        source, number, at = index.to_numpy(), block.to_numpy(), np.zeros(len(index), dtype=np.int64)
        for i in np.unique(source):
            own = source == i
            at[own] = np.searchsorted(done[:, i], number[own], side="right") - 1
        order = np.argsort(at, kind="stable")
        for some in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
            if len(some):
                k = at[some[0]]
                share = done[k + 1] - done[k]
                if (key := share.tobytes()) not in known:
                    if len(known) * period >= MOST_PERIOD:
                        known.clear()
                    # sources without a block in this period are no part of its schedule
                    plan = schedule({f"{i:08}": int(share[i]) for i in np.flatnonzero(share)})
                    known[key] = {int(i): np.array(s, dtype=np.int64) for i, s in plan.items()}
                within = number[some] - done[k][source[some]]
                for i in np.unique(source[some]):
                    own = source[some] == i
                    out[some[own]] = k * period + known[key][i][within[own]]
        return pd.Series(out)

    slot = F.pandas_udf(run, "long")(F.col("_index"), F.col("block"))
    return place.join(F.broadcast(table), F.col(source_col).cast("string").eqNullSafe(F.col("_source"))).select(
        *docs.columns, "block", slot.alias("slot"), (F.col("_rank") % block_rows).cast("int").alias("place")
    )
