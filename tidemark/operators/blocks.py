"""Tracks as blocks of samples, seen with some samples of the blocks around them.

A kernel that looks a little behind and ahead gets, for each block, one array with both; only those samples of the neighbours travel. So a
track of any length spreads over the cluster, and a block's result does not depend on how blocks are dealt.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources.wav import BLOCK, resample_part


def mono(blocks: DataFrame, *more: str) -> DataFrame:
    """(track_id, more, rate, block_no, start_sample, x): the mean of both channels."""
    both = F.zip_with("left", "right", lambda a, b: ((a + b) / 2).cast("float"))
    return blocks.select("track_id", *more, "rate", "block_no", "start_sample", both.alias("x"))


def lengths(samples: DataFrame, key: Sequence[str] = ("track_id",)) -> DataFrame:
    """(key, n, rate): samples and rate of each track."""
    return samples.groupBy(*key).agg(F.max(F.col("start_sample") + F.size("x")).alias("n"), F.first("rate").alias("rate"))


def haloed(samples: DataFrame, behind: int, ahead: int, key: Sequence[str] = ("track_id",), block: int | Callable[[Column], Column] = BLOCK) -> DataFrame:
    """(key, n, rate, block_no, begin, x): each block with up to ``behind`` and ``ahead`` samples around it; ``begin`` is where x starts.

    samples: (key, rate, start_sample, x) in blocks of any size. ``block`` is the size of the blocks that come out; it may follow from the
    rate and be broken: block k covers the samples from k * block on.
    """
    size = F.lit(block) if isinstance(block, int) else block(F.col("rate"))
    start, end = F.col("start_sample"), F.col("start_sample") + F.size("x")
    first, last = F.floor((start - ahead) / size) - 1, F.floor((end + behind) / size) + 1
    rows = samples.withColumn("_block", F.explode(F.sequence(F.greatest(first, F.lit(0)), last)))
    low = F.greatest(start, F.floor(F.col("_block") * size).cast("long") - behind)
    high = F.least(end, F.ceil((F.col("_block") + 1) * size).cast("long") + ahead)
    parts = rows.withColumn("_low", low).withColumn("_high", high).where("_low < _high")
    piece = F.struct(F.col("_low").alias("at"), F.slice("x", (F.col("_low") - start + 1).cast("int"), (F.col("_high") - F.col("_low")).cast("int")).alias("x"))
    met = parts.groupBy(*key, F.col("_block").alias("block_no")).agg(F.sort_array(F.collect_list(piece)).alias("_p"))
    whole = met.select(*key, "block_no", F.col("_p")[0]["at"].alias("begin"), F.flatten(F.transform("_p", lambda p: p["x"])).alias("x"))
    known = lengths(samples, key).withColumnRenamed("n", "_n").withColumnRenamed("rate", "_rate")
    placed = whole.join(known, list(key)).withColumnRenamed("_n", "n").withColumnRenamed("_rate", "rate")
    return placed.where(F.floor(F.col("block_no") * size) < F.col("n")).select(*key, "n", "rate", "block_no", "begin", "x")


def each_row(df: DataFrame, kernel: Callable[..., Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that ``kernel`` makes of each row of ``df``; arrays come as NumPy arrays."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                made = list(kernel(row))
                if made:
                    yield pd.DataFrame(made, columns=names)

    return df.mapInPandas(run, schema)


#: Samples of the source around those that a resampled block covers.
REACH = 4096


def resampled(samples: DataFrame, rate: int, block: int = BLOCK, taps: int = 32) -> DataFrame:
    """(track_id, rate, block_no, start_sample, x) of tracks at another rate, block by block: the same samples as of the whole track at once."""

    def kernel(row: tuple) -> Iterator[tuple]:
        total = row.n if row.rate == rate else int(np.floor(row.n * rate / row.rate + 0.5))
        first, last = row.block_no * block, min(total, (row.block_no + 1) * block)
        if first < last:
            x = np.asarray(row.x, dtype=np.float32)
            if row.rate != rate and taps * max(1.0, row.rate / rate) > REACH - 2:
                raise ValueError(f"{row.rate} samples a second are too many to be {rate}")
            made = x[first - row.begin : last - row.begin] if row.rate == rate else resample_part(x[None], row.begin, first, last, row.rate, rate, taps)[0]
            yield row.track_id, rate, row.block_no, first, made

    around = haloed(samples, REACH, REACH, block=lambda own: own * (block / rate))
    return each_row(around, kernel, "track_id string, rate int, block_no long, start_sample long, x array<float>")
