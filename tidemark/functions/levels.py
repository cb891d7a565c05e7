"""Column functions over magnitudes: mel scale, windows, compression and decibels."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def mel_of(hz: Column) -> Column:
    return 2595 * F.log10(1 + hz / 700)


def hz_of(mel: Column) -> Column:
    return 700 * (F.pow(F.lit(10.0), mel / 2595) - 1)


def hann_windowed(x: Column, n: int) -> Column:
    """The first ``n`` numbers of an array under a periodic Hann window."""
    weights = F.array(*[F.lit(0.5 - 0.5 * math.cos(2 * math.pi * k / n)) for k in range(n)])
    return F.zip_with(F.slice(x, 1, n), weights, lambda v, w: v.cast("double") * w)


def compressed(magnitudes: Column, frame: int, amount: float = 100.0) -> Column:
    """log(1 + amount * m), with magnitudes scaled by 4 / frame."""
    return F.transform(magnitudes, lambda m: F.log1p(F.lit(amount * 4 / frame) * F.abs(m.cast("double"))))


def bin_weight(k: Column) -> Column:
    """One over the width of a sixth of an octave at a bin, at most 1; nothing for bin 0."""
    return F.when(k == 0, F.lit(0.0)).otherwise(1 / F.greatest(F.lit(1.0), k * F.lit(2 ** (1 / 6) - 1)))


def band_decibels(x: Column, edges: Sequence[int]) -> Column:
    """10 * log10 of the energy between neighbouring edges of an array."""
    energy = lambda a, b: F.aggregate(F.slice(x, a + 1, b - a), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    return F.array(*[10 * F.log10(energy(a, b) + 1e-12) for a, b in zip(edges[:-1], edges[1:], strict=True)])


def below_peak(power: Column, peak: Column, floor: float = -80.0) -> Column:
    """Power in dB under a peak (a mix's, say), never below ``floor``."""
    return F.greatest(10 * F.log10(F.greatest(power, F.lit(1e-30)) / peak), F.lit(floor))
