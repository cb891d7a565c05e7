"""From audio to a song's events: windows around an injected encoder and decoder, one after the other for a track, tracks side by side.

Round k is one plan over the k-th window of every track that has one. Its samples are gathered from 24 kHz blocks, the events kept so far are put
before the decoder as its prefix, and what it says is parsed, timed and cut to what the window may say. Only that depends on the rounds before;
a task holds one window's samples and one decoder. Each round's events are checkpointed, so a lost executor costs a window, and no plan
grows with the rounds.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import music as M
from tidemark.operators.blocks import lengths, mono, resampled
from tidemark.operators.hopping import window_table
from tidemark.plans.models import Model, Transcriber, loaded, require, session
from tidemark.plans.tables import settled
from tidemark.plans.transcription import Transcription, describe, greedy_decode, overlap_prefix, parse_events, stitch
from tidemark.sources.wav import BLOCK

RATE, LENGTH, OVERLAP, LOOKAHEAD, MOST = 24_000, 300.0, 200.0, 100.0, 5120
#: Tokens that a prefix leaves for the window's own.
ROOM = 128


def windows_of(samples: DataFrame, length: float = LENGTH, overlap: float = OVERLAP, lookahead: float = LOOKAHEAD) -> DataFrame:
    """(track_id, window_no, start, accept_start, accept_end, duration, stop): every track's windows; stop: seconds into a window at which its tokens end."""
    tracks = lengths(samples).select("track_id", (F.col("n") / F.col("rate")).alias("duration"))
    plan = window_table(tracks, ["track_id"], "duration", length, overlap, lookahead).join(tracks, "track_id")
    final = F.col("accept_end") >= F.col("duration")
    stop = F.when(final, F.least(F.col("duration") - F.col("start"), F.lit(length))).otherwise(F.lit(length - lookahead))
    return plan.select("track_id", "window_no", "start", "accept_start", "accept_end", "duration", stop.alias("stop"))


def generate(samples: DataFrame, told: DataFrame, load: Callable[[], Transcriber], rate: int, length: float, most: int = MOST, block: int = BLOCK) -> DataFrame:
    """(track_id, window_no, pos, token): what the decoder says of one window of each track. told: a row for each, (track_id, window_no, start, stop, tokens)."""
    size = int(length * rate)
    first = F.floor(F.col("start") * rate + 0.5)
    need = told.select("*", F.explode(F.sequence(F.floor(first / block), F.floor((first + size - 1) / block))).alias("block_no"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        one = rows.iloc[0]
        begin, prefix = int(np.floor(one["start"] * rate + 0.5)), [int(t) for t in one["tokens"]]
        if len(prefix) >= most - ROOM:
            raise ValueError(f"the events kept of track {key[0]} fill the decoder's context at {one['start']} s")
        heard = np.zeros(size, dtype=np.float32)
        for at, x in zip(rows["start_sample"], rows["x"], strict=True):
            a, b = max(begin, at), min(begin + size, at + len(x))
            heard[a - begin : b - begin] = x[a - at : b - at]
        with session(loaded(load), heard) as decoder:
            tokens = greedy_decode(decoder, prefix, float(one["stop"]), most)
        return pd.DataFrame({"track_id": key[0], "window_no": int(one["window_no"]), "pos": np.arange(len(tokens)), "token": tokens})

    parts = need.join(samples.select("track_id", "block_no", "start_sample", "x"), ["track_id", "block_no"])
    return parts.groupBy("track_id").applyInPandas(run, "track_id string, window_no int, pos int, token int")


def transcribe(
    blocks: DataFrame,
    model: Model | Callable[[], Transcriber],
    rate: int = RATE,
    length: float = LENGTH,
    overlap: float = OVERLAP,
    lookahead: float = LOOKAHEAD,
    most: int = MOST,
    block: int = BLOCK,
) -> Transcription:
    """The events of every track of audio blocks, timed in the track.

    A :class:`~tidemark.plans.models.Model` that does not take ``samples`` of a window and a ``token``, or does not give ``scores``, is
    refused before anything runs. Tracks without samples have no events.
    """
    load = require(model, {"samples": (int(length * rate),), "token": ()}, {"scores": (M.DURATION.stop,)})
    samples = settled(resampled(mono(blocks), rate, block))
    plan = settled(windows_of(samples, length, overlap, lookahead))
    rounds = plan.agg(F.max("window_no")).first()[0]
    prompt = F.array(*map(F.lit, M.PROMPT))
    kept: list[DataFrame] = []
    for k in range(-1 if rounds is None else rounds + 1):
        now = plan.where(F.col("window_no") == k)
        told = now.withColumn("tokens", prompt).withColumn("base", F.lit(0).cast("long"))
        if kept:
            spans = now.select("track_id", F.col("start").alias("from"), F.col("accept_start").alias("until"))
            before = overlap_prefix(functools.reduce(DataFrame.unionByName, kept), spans).select("track_id", F.col("tokens").alias("_said"), F.col("base").cast("long").alias("_base"))
            both = told.join(before, "track_id", "left")
            told = both.withColumn("tokens", F.coalesce("_said", "tokens")).withColumn("base", F.coalesce("_base", "base")).drop("_said", "_base")
        told = settled(told)
        tokens = settled(generate(samples, told, load, rate, length, most, block))
        kept.append(settled(stitch(settled(describe(parse_events(tokens))), told.drop("stop", "tokens"), length)))
    if not kept:
        blank = blocks.sparkSession.createDataFrame([], "track_id string, window_no int, pos int, token int")
        kept = [stitch(describe(parse_events(blank)), plan.withColumn("base", F.lit(0).cast("long")).drop("stop"), length)]
    return Transcription(functools.reduce(DataFrame.unionByName, kept))
