"""Column functions over arrays that hold signals, levels or tokens."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def downmix(*channels: Column) -> Column:
    """Mean of the channels, sample by sample; the shortest sets the length."""
    total = channels[0]
    for c in channels[1:]:
        total = F.zip_with(total, c, lambda x, y: x + y)
    return F.filter(F.transform(total, lambda x: x / len(channels)), lambda x: x.isNotNull())


def residual(whole: Column, part: Column) -> Column:
    """What is left of ``whole`` without ``part``."""
    return F.zip_with(whole, part, lambda x, y: x - y)


def peak(x: Column) -> Column:
    return F.array_max(F.transform(x, F.abs))


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v) / F.size(x))


def rises_at(x: Column, at: Column, width: int, ratio: float = 1.2) -> Column:
    """Whether ``width`` samples from a place on are ``ratio`` times as loud as those before it; true at the very start."""
    before = F.slice(x, F.greatest(at - width, F.lit(0)) + 1, F.least(at, F.lit(width)))
    return (at == 0) | (rms(F.slice(x, at + 1, F.lit(width))) > ratio * rms(before))


def reflect_index(i: Column, n: Column) -> Column:
    """Place in an array of ``n`` that position ``i`` mirrors, edges not repeated, as often as needed."""
    period = F.greatest(2 * (n - 1), F.lit(1))
    m = F.pmod(i, period)
    return F.when(m < n, m).otherwise(period - m)


def reflect_pad(x: Column, left: int, right: int) -> Column:
    n = F.size(x)
    return F.transform(F.sequence(F.lit(-left), n + right - 1), lambda i: F.get(x, reflect_index(i, n)))


def centred_segment(x: Column, at: int, count: int, size: int) -> Column:
    """``size`` samples with ``[at, at + count)`` in the middle: real neighbours around it, zeros outside the array."""
    start = at - (size - count) // 2
    return F.transform(F.sequence(F.lit(start), F.lit(start + size - 1)), lambda i: F.when((i >= 0) & (i < F.size(x)), F.get(x, i)).otherwise(F.lit(0.0)))


def fade(x: Column, into: int, out: int, from_start: Column | bool = False) -> Column:
    """Linear ramps over the first ``into`` and the last ``out`` samples; a piece from the very start has no ramp up."""
    n = F.size(x)
    start = from_start if isinstance(from_start, Column) else F.lit(from_start)
    up = F.when(start, F.lit(0)).otherwise(F.least(n, F.lit(into)))
    down = F.least(n - up, F.lit(out))

    def ramp(v: Column, i: Column) -> Column:
        rising = F.when(i < up, i / up).otherwise(F.lit(1.0))
        falling = F.when(n - 1 - i < down, (n - 1 - i) / down).otherwise(F.lit(1.0))
        return v * rising * falling

    return F.transform(x, ramp)


def levelled(x: Column, below: float = 60.0) -> Column:
    """Levels raised to at least ``below`` under their highest, less their mean; an empty array stays."""
    # one-element arrays bind what every element needs, so it is computed once
    raised = F.transform(F.array(F.array_max(x).cast("double") - below), lambda floor: F.transform(x, lambda v: F.greatest(v.cast("double"), floor)))[0]
    mean = lambda r: F.aggregate(r, F.lit(0.0), lambda s, v: s + v) / F.size(r)
    centred = F.transform(F.array(raised), lambda r: F.transform(F.array(mean(r)), lambda m: F.transform(r, lambda v: v - m))[0])[0]
    return F.when(F.size(x) > 0, centred).otherwise(x.cast("array<double>"))


def split_steps(total: Column, most: int, base: int) -> Column:
    """``total`` as tokens ``base + step`` whose steps add up to it, all but the last of ``most``; zero is one token."""
    whole = F.floor((F.greatest(total, F.lit(1)) - 1) / most).cast("int")
    return F.concat(F.array_repeat(F.lit(base + most), whole), F.array((total - whole * most + base).cast("int")))


def mean_in_db(x: Column) -> Column:
    """10 * log10 of the energy of an array."""
    return 10 * F.log10(F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v) + 1e-12)


def mirrored_tail(x: Column, size: int) -> Column:
    """``x`` made ``size`` long by its own end read backwards, edge not repeated, and zeros where that runs out."""
    n = F.size(x)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.when(i < n, F.get(x, i)).when(2 * (n - 1) - i >= 0, F.get(x, 2 * (n - 1) - i)).otherwise(F.lit(0.0)))


def masked_argmax(x: Column, allowed: Sequence[range]) -> Column:
    """Place of the largest value within the allowed ranges, the first of several."""
    places = F.filter(F.transform(x, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))), lambda p: functools.reduce(Column.__or__, [(-p["i"] >= r.start) & (-p["i"] < r.stop) for r in allowed]))
    return -F.array_max(places)["i"]


def merged(left: Column, right: Column) -> Column:
    """Two maps as one; where both have a key, the right one's value."""
    return F.map_from_entries(F.concat(F.filter(F.map_entries(left), lambda e: ~F.map_contains_key(right, e["key"])), F.map_entries(right)))
