"""What a picture of a song's stems shows: mel power of each stem in decibels against the mix's peak."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import signal as S
from tidemark.operators.blocks import each_row, haloed, mono
from tidemark.sources.wav import BLOCK

FLOOR_DB = -80.0


def display(stems: DataFrame, mix: str = "mix", bands: int = 128, frame: int = 4096, hop: int = 1024, floor: float = FLOOR_DB, block: int = BLOCK) -> DataFrame:
    """(track_id, stem, frame_no, levels): one row for each frame of audio blocks with a ``stem``; songs without a mix, or with a silent one, have none.

    Spectra are made block by block; only the mix's peak, a number for each track, is known to all blocks.
    """

    def kernel(row: tuple) -> Iterator[tuple]:
        first = -(-row.block_no * block // hop)
        last = row.n // hop + 1 if (row.block_no + 1) * block >= row.n else -(-(row.block_no + 1) * block // hop)
        if first < last:
            power = S.mel_power_of_frames(np.asarray(row.x, dtype=np.float64), row.begin, first, last, float(row.rate), bands, frame, hop)
            for k, p in enumerate(power):
                yield row.track_id, row.stem, first + k, p

    powers = each_row(haloed(mono(stems, "stem"), frame, frame, ("track_id", "stem"), block), kernel, "track_id string, stem string, frame_no long, power array<double>")
    peaks = powers.where(F.col("stem") == mix).groupBy("track_id").agg(F.max(F.array_max("power")).alias("_peak")).where("_peak > 0")
    against = lambda p: F.greatest(10 * F.log10(F.greatest(p / F.col("_peak"), F.lit(1e-12))), F.lit(floor)).cast("float")
    return powers.join(peaks, "track_id").select("track_id", "stem", "frame_no", F.transform("power", against).alias("levels"))
