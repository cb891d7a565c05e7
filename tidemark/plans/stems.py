"""Songs to stems, kits and loops: chunked separation around an injected model, residuals, and what is cut from stems.

A separator is a callable from (channels, samples) to the same shape, loaded in the task; models are not part of this package.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.arrays import levelled, residual
from tidemark.operators import blocks as B
from tidemark.operators import joins, onsets, series, summaries
from tidemark.operators import signal as S
from tidemark.operators.similarity import group_means, rms_distance, similarity_groups
from tidemark.plans.models import Model, loaded, require
from tidemark.plans.tables import settled
from tidemark.sources.wav import BLOCK, encode_wav, joined, resample

STEMS = ("mix", "vocals", "instrumental", "horns", "drums", "bass", "other")
KIT_THRESHOLD, KIT_FEWEST, LOOP_THRESHOLD = 6.0, 3, 4.5

Separator = Callable[[np.ndarray], np.ndarray]
PIECES = "track_id string, folder string, name string, start long, end long, fade_in double, fade_out double"


@dataclass(frozen=True)
class Options:
    """What to make of a song."""

    kit: frozenset[str] = field(default_factory=frozenset)
    loops: frozenset[str] = field(default_factory=frozenset)
    bars: int = 4
    bpm: float | None = None
    transcribe: bool = False
    device: bool = False

    def __post_init__(self) -> None:
        if unknown := sorted((self.kit | self.loops) - set(STEMS)):
            raise ValueError(f"unknown stem: {unknown[0]}")
        if self.bars <= 0:
            raise ValueError("bars must be positive")
        if self.bpm is not None and not 20 <= self.bpm <= 400:
            raise ValueError("bpm must lie between 20 and 400")
        if not self.loops and (self.bars != 4 or self.bpm is not None):
            raise ValueError("bars and bpm are for loops")


PARTS = "track_id string, block_no long, at long, left array<double>, right array<double>, weight array<double>"


def _sizes(blocks: DataFrame) -> DataFrame:
    """(track_id, n, _rate): samples and rate of each track."""
    return blocks.groupBy("track_id").agg(F.max(F.col("start_sample") + F.size("left")).alias("n"), F.first("rate").alias("_rate"))


def _dealt(audio: np.ndarray, weight: np.ndarray, begin: int, n: int, block: int) -> Iterator[tuple]:
    """What audio that begins at a place of a track of ``n`` samples says of each block: (block_no, place in it, left, right, weight)."""
    final = min(n, begin + len(weight))
    for k in range(max(0, begin) // block, (final - 1) // block + 1):
        a, b = max(begin, k * block, 0), min(final, (k + 1) * block)
        if a < b:
            w = weight[a - begin : b - begin]
            left, right = (audio[:, a - begin : b - begin] * w).astype(np.float64)
            yield k, a - k * block, left, right, w


def _met(parts: DataFrame, sizes: DataFrame, by: list[str], block: int) -> DataFrame:
    """Audio blocks as weighted means of the parts of each; ``by`` begins with track_id and block_no."""

    def add(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        size = int((rows["at"] + rows["weight"].map(len)).max())
        total, sums = np.zeros(size), np.zeros((2, size))
        for r in rows.sort_values("at").itertuples():
            where = slice(r.at, r.at + len(r.weight))
            total[where] += r.weight
            sums[0, where] += r.left
            sums[1, where] += r.right
        left, right = (sums / np.maximum(total, 1e-8)).astype(np.float32)
        values = {"track_id": [key[0]], "rate": [int(rows["_rate"].iloc[0])], "block_no": [key[1]], "start_sample": [key[1] * block], "left": [left], "right": [right]}
        return pd.DataFrame(values | {c: [v] for c, v in zip(by[2:], key[2:], strict=True)})

    rated = parts.join(sizes.select("track_id", "_rate"), "track_id")
    more = "".join(f", {c} string" for c in by[2:])
    return rated.groupBy(*by).applyInPandas(add, "track_id string, rate int, block_no long, start_sample long, left array<float>, right array<float>" + more)


def separate(blocks: DataFrame, model: Model | Callable[[], Separator], chunk: int = 352_800, block: int = BLOCK) -> DataFrame:
    """The stem that a separator hears in each track, in the same blocks.

    Chunks overlap by half, with linear ramps over a tenth at both ends, and see the track mirrored beyond its edges. Each
    (track, chunk) is one task's group, and the weighted parts of a block meet in a second grouping, so tracks of any
    length spread over the cluster and the order in which chunks finish does not matter. A model that says it does not take or
    give ``audio`` of a chunk is refused before anything runs.
    """
    load = require(model, {"audio": (2, chunk)}, {"audio": (2, chunk)})
    step, ramp = chunk // 2, chunk // 10
    border = chunk - step
    sizes = _sizes(blocks)
    total = F.col("n") + 2 * border
    chunks = sizes.select("track_id", "n", F.explode(F.sequence(F.lit(0), F.ceil(total / step) - 1)).alias("chunk_no"))
    first = F.col("chunk_no") * step - border
    reach = chunks.withColumn("lo", F.greatest(F.least(first, F.col("n") - 1 - border - chunk), F.lit(0))).withColumn("hi", F.greatest(first + chunk, F.lit(border + 1)))
    need = reach.select("track_id", "n", "chunk_no", F.explode(F.sequence(F.floor(F.col("lo") / block), F.floor(F.least("hi", F.col("n") - 1) / block))).alias("block_no"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, number = int(rows["n"].iloc[0]), int(key[1])
        base, audio = int(rows["start_sample"].min()), joined(rows)
        begin = number * step - border
        place = S.mirrored(np.arange(begin, begin + chunk), n) - base
        heard = np.asarray(loaded(load)(audio[:, np.clip(place, 0, audio.shape[1] - 1)]))
        if heard.shape != (2, chunk):
            raise ValueError(f"the separator gave an array of {heard.shape} for one of {(2, chunk)}")
        weight = np.ones(chunk)
        if begin > -border:
            weight[:ramp] = np.linspace(0, 1, ramp)
        if begin + chunk < n + border:
            weight[chunk - ramp :] = np.linspace(1, 0, ramp)
        out = [(key[0], *part) for part in _dealt(heard, weight, begin, n, block)]
        return pd.DataFrame(out, columns=["track_id", "block_no", "at", "left", "right", "weight"])

    parts = need.join(blocks, ["track_id", "block_no"]).groupBy("track_id", "chunk_no").applyInPandas(run, PARTS)
    return _met(parts, sizes, ["track_id", "block_no"], block)


@dataclass(frozen=True)
class Core:
    """One model that hears several sources at once: ``load`` gives a callable from (2, segment) to (sources, 2, segment)."""

    load: Model | Callable[[], Separator]
    sources: tuple[str, ...]
    segment: int = 343_980


def separate_all(blocks: DataFrame, core: Core, block: int = BLOCK) -> DataFrame:
    """Every source of a core in each track, in the same blocks, with a ``stem``.

    Segments begin every three quarters of their length and weigh most in their middle. One that the track's end cuts short is
    put in the middle of the core's input, with as much of the track before it as there is room for; beyond the track is
    silence. Each (track, segment) is a group of its own, and what segments say of a block meets in a second grouping.
    """
    segment, sources = core.segment, core.sources
    load = require(core.load, {"audio": (2, segment)}, {"sources": (len(sources), 2, segment)})
    sizes = _sizes(blocks)
    starts = sizes.where("n > 0").select("track_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(segment * 3 // 4).cast("long"))).alias("offset"))
    first = F.col("offset") - F.floor((segment - F.least(F.lit(segment), F.col("n") - F.col("offset"))) / 2)
    reach = F.sequence(F.floor(F.greatest(first, F.lit(0)) / block), F.floor((F.least("n", first + segment) - 1) / block))
    need = starts.select("track_id", "n", "offset", F.explode(reach).alias("block_no"))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        n, offset = int(rows["n"].iloc[0]), int(key[1])
        base, audio = int(rows["start_sample"].min()), joined(rows)
        count = min(segment, n - offset)
        trim = (segment - count) // 2
        a, b = max(0, offset - trim), min(n, offset - trim + segment)
        given = np.zeros((2, segment), dtype=np.float32)
        given[:, a - offset + trim : b - offset + trim] = audio[:, a - base : b - base]
        heard = np.asarray(loaded(load)(given))
        if heard.shape != (len(sources), 2, segment):
            raise ValueError(f"the core gave an array of {heard.shape}, not of {(len(sources), 2, segment)}")
        at = np.arange(count)
        weight = np.minimum(at + 1, segment - at) / (segment // 2)
        parts = [(key[0], *part, name) for name, own in zip(sources, heard, strict=True) for part in _dealt(own[:, trim : trim + count], weight, offset, n, block)]
        return pd.DataFrame(parts, columns=["track_id", "block_no", "at", "left", "right", "weight", "stem"])

    parts = need.join(blocks, ["track_id", "block_no"]).groupBy("track_id", "offset").applyInPandas(run, PARTS + ", stem string")
    return _met(parts, sizes, ["track_id", "block_no", "stem"], block)


def subtract(whole: DataFrame, part: DataFrame) -> DataFrame:
    """What a stem leaves of its mix, block by block."""
    other = part.select("track_id", "block_no", F.col("left").alias("_l"), F.col("right").alias("_r"))
    both = whole.join(other, ["track_id", "block_no"])
    return both.select("track_id", "rate", "block_no", "start_sample", residual(F.col("left"), F.col("_l")).alias("left"), residual(F.col("right"), F.col("_r")).alias("right"))


#: Samples around a block that its attacks depend on, at rates up to ``FASTEST``.
FASTEST = 48_000
HALO = onsets.reach(FASTEST)


def _heard(blocks: DataFrame, behind: int, ahead: int, block: int = BLOCK) -> DataFrame:
    """Mono blocks with what is around them."""
    return B.haloed(B.mono(blocks), behind, ahead, block=block)


def _checked(rate: float) -> float:
    if rate > FASTEST:
        raise ValueError(f"{rate} samples a second are more than {FASTEST}; resample first")
    return float(rate)


def loudness(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """(track_id, loudest, strongest): each track's loudest sample and the strongest growth of its spectrum."""

    def kernel(row: tuple) -> Iterator[tuple]:
        x, own = np.asarray(row.x, dtype=np.float64), row.block_no * block - row.begin
        first, last = onsets.frame_range(row.block_no, block, row.n)
        growth = S.flux_of_frames(x, row.begin, first, last, [range(S.FRAME // 2)])[0]
        yield row.track_id, S.peak(x[own : own + block]), float(growth.max(initial=0.0)) if _checked(row.rate) else 0.0

    parts = B.each_row(_heard(blocks, HALO, HALO, block), kernel, "track_id string, loudest double, strongest double")
    return parts.groupBy("track_id").agg(F.max("loudest").alias("loudest"), F.max("strongest").alias("strongest"))


def attacks(blocks: DataFrame, block: int = BLOCK, loud: DataFrame | None = None) -> DataFrame:
    """(track_id, attack): onsets of each track's mono sum, found block by block; only their distances are tested along the track. loud: :func:`loudness`."""

    def kernel(row: tuple) -> Iterator[tuple]:
        frames = onsets.frame_range(row.block_no, block, row.n)
        found = onsets.candidates(np.asarray(row.x, dtype=np.float64), row.begin, row.n, _checked(row.rate), frames, row.strongest, row.loudest)
        gap = int(onsets.GAP_S * row.rate)
        return ((row.track_id, int(at), gap) for at in found)

    around = _heard(blocks, HALO, HALO, block).join(loudness(blocks, block) if loud is None else loud, "track_id")
    found = B.each_row(around, kernel, "track_id string, attack long, gap long")
    return series.min_gap(found, ["track_id"], "attack", "gap").drop("gap")


HITS = "track_id string, attack long, following long, start long, end long, n long, rate int, loud double, ring double, print array<double>"


def hits(blocks: DataFrame, found: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """``HITS``: the sound of every attack, its range, its peak, the level of what rings on before it, and its fingerprint. found: :func:`attacks`."""
    loud = settled(loudness(blocks, block))  # a row for each track, read twice
    sizes, lead = B.lengths(B.mono(blocks)), F.floor(F.lit(onsets.PREROLL_S) * F.col("rate"))
    known = (attacks(blocks, block, loud) if found is None else found).join(sizes, "track_id")
    w = series.series(["track_id"], ["attack"])
    placed = known.withColumn("start", F.greatest(F.col("attack") - lead, F.lit(0))).select(
        "track_id", F.floor(F.col("attack") / block).alias("block_no"), "attack", "start",
        F.coalesce(F.lead("attack").over(w), "n").alias("following"), F.coalesce(F.lead("start").over(w), "n").alias("until"),
    )
    told = placed.groupBy("track_id", "block_no").agg(F.sort_array(F.collect_list(F.struct("attack", "start", "following", "until"))).alias("hits"))

    def kernel(row: tuple) -> Iterator[tuple]:
        x, edges = np.asarray(row.x, dtype=np.float64), S.mel_edges(_checked(row.rate))
        for h in row.hits:
            end, loud, ring, features = onsets.describe_hit(x, row.begin, h["attack"], h["following"], h["until"], row.rate, row.loudest, edges)
            yield row.track_id, h["attack"], h["following"], h["start"], end, row.n, row.rate, loud, ring, features

    ahead = int(S.LONGEST_S * FASTEST) + 4096
    around = _heard(blocks, int(onsets.PREROLL_S * FASTEST), ahead, block).join(told, ["track_id", "block_no"]).join(loud, "track_id")
    return B.each_row(around, kernel, HITS)


def _numbered(number: str, width: Column) -> Column:
    return F.lpad(F.col(number).cast("string"), width, "0")


def kits(blocks: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pieces of each track's kit: of every sound the cleanest of the half of its hits that is most typical, the most frequent sound first.

    Hits are grouped in the order of their peaks; sounds of fewer than ``KIT_FEWEST`` hits go, unless all have fewer.
    """
    key, sound = ["track_id"], ["track_id", "group_id"]
    timed = hits(blocks, block=block).withColumn("_at", F.col("attack") / F.col("rate"))
    clean = series.mess_score(timed, key, "_at", "ring", "loud", F.col("n") / F.col("rate"))
    ordered = clean.withColumn("ordinal", F.row_number().over(series.series(key, [F.desc("loud"), "attack"])))
    # read several times below, and small beside the audio
    grouped = settled(similarity_groups(ordered, key, "ordinal", "print", KIT_THRESHOLD))
    sizes = summaries.having_unless_none(grouped.groupBy(*sound).agg(F.count("*").alias("_n"), F.min("attack").alias("_first")), "_n", KIT_FEWEST, key)
    turn = F.row_number().over(series.series(key, [F.desc("_n"), "_first"]))
    ranked = sizes.withColumn("_no", turn).withColumn("_all", F.count("*").over(series.Window.partitionBy(*key)))
    off = grouped.join(group_means(grouped, sound, "print"), sound).withColumn("_off", rms_distance(F.col("print"), F.col("mean")))
    typical = summaries.nearest_half(off, sound, "_off", "ordinal")
    best = summaries.first_extreme(typical, sound, "mess", "_off").join(ranked, sound)
    name = _numbered("_no", F.greatest(F.lit(2), F.length(F.col("_all").cast("string"))))
    return best.select("track_id", F.lit("kit").alias("folder"), name.alias("name"), "start", "end", F.lit(onsets.PREROLL_S).alias("fade_in"), F.lit(0.005).alias("fade_out"))


def envelopes(drums: DataFrame, block: int = BLOCK) -> DataFrame:
    """(track_id, rate, block_no, full, kick): growth of the spectrum from frame to frame, over all bins and over the kick's."""

    def kernel(row: tuple) -> Iterator[tuple]:
        first, last = onsets.frame_range(row.block_no, block, row.n)
        flux = S.flux_of_frames(np.asarray(row.x, dtype=np.float64), row.begin, first, last, [range(S.FRAME // 2), S.kick_band(row.rate)])
        yield row.track_id, row.rate, row.block_no, flux[0], flux[1]

    return B.each_row(_heard(drums, HALO, HALO, block), kernel, "track_id string, rate int, block_no long, full array<double>, kick array<double>")


def grids(drums: DataFrame, bpm: float | None = None, block: int = BLOCK) -> DataFrame:
    """(track_id, bpm, downbeats): tempo and bar lines of each track's drums; tracks without eight beats are missing.

    Spectra are made block by block; the search for beats, which is one chain along a track, reads its two numbers a frame.
    """

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows, rate = rows.sort_values("block_no"), float(rows["rate"].iloc[0])
        found = S.beats_in_four(np.concatenate(list(rows["full"])), np.concatenate(list(rows["kick"])), rate, bpm)
        tempo, lines = found or (0.0, [])
        return pd.DataFrame({"track_id": key[0], "bpm": tempo, "reach": int(0.03 * rate), "sample": np.asarray(lines, dtype=np.int64)})

    lines = envelopes(drums, block).groupBy("track_id").applyInPandas(run, "track_id string, bpm double, reach long, sample long")
    moved = joins.snap(lines, attacks(drums, block), ["track_id"], "sample", "attack", "reach")
    return moved.groupBy("track_id", "bpm").agg(F.array_sort(F.collect_list("snapped")).alias("downbeats"))


def _peaks(samples: DataFrame, spans: DataFrame, block: int) -> DataFrame:
    """``spans`` (track_id, bar, start, end) with ``_peak``, the loudest sample in each."""
    reached = spans.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    parts = reached.join(samples.select("track_id", "block_no", "start_sample", "x"), ["track_id", "block_no"])
    low, high = F.greatest("start", "start_sample"), F.least("end", F.col("start_sample") + F.size("x"))
    some = F.slice("x", (low - F.col("start_sample") + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int"))
    top = F.coalesce(F.array_max(F.transform(some, lambda v: F.abs(v))), F.lit(0.0)).cast("double")
    return parts.select(*spans.columns, top.alias("_top")).groupBy(*spans.columns).agg(F.max("_top").alias("_peak"))


def loops(blocks: DataFrame, grid: DataFrame, bars: int = 4, block: int = BLOCK) -> DataFrame:
    """Pieces of each track's loops, for tracks of ``grid`` (track_id, bpm, downbeats): every ``bars`` bars of music that sound like none before them.

    A loop's features are the bands at its sixteenths, found in the blocks they lie in.
    """
    key, steps = ["track_id"], bars * 16
    samples = B.mono(blocks)
    lines = grid.select("track_id", "bpm", F.size("downbeats").alias("_lines"), F.posexplode("downbeats").alias("_i", "sample"))
    known = grid.select("track_id", "bpm", F.size("downbeats").alias("_lines"))
    spans = series.every_nth_span(lines, key, "sample", bars).join(B.lengths(samples), "track_id")
    spans = settled(spans.select("track_id", F.col("bar").cast("long").alias("bar"), "start", F.least("end", "n").alias("end")).where("start < end"))
    loud = _peaks(samples, spans, block).join(loudness(blocks, block), "track_id").where(F.col("_peak") > F.col("loudest") * S.SILENCE)
    each = loud.select("track_id", "bar", "start", "end", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"))
    at = F.col("start") + F.floor((F.col("end") - F.col("start")) * F.col("step") / steps)
    told = each.withColumn("at", at).groupBy("track_id", F.floor(F.col("at") / block).alias("block_no")).agg(F.collect_list(F.struct("bar", "step", "at", "end")).alias("steps"))

    def kernel(row: tuple) -> Iterator[tuple]:
        x, edges = np.asarray(row.x, dtype=np.float64), S.mel_edges(row.rate)
        for s in row.steps:
            a = s["at"] - row.begin
            yield row.track_id, s["bar"], s["step"], S.band_levels(x[a : a + min(S.MEL_FRAME, s["end"] - s["at"])], edges)

    bands = B.each_row(_heard(blocks, 0, S.MEL_FRAME, block).join(told, ["track_id", "block_no"]), kernel, "track_id string, bar long, step int, levels array<double>")
    listed = bands.groupBy("track_id", "bar").agg(F.sort_array(F.collect_list(F.struct("step", "levels"))).alias("_s"))
    prints = listed.select("track_id", "bar", levelled(F.flatten(F.transform("_s", lambda s: s["levels"]))).alias("print"))
    firsts = similarity_groups(prints, key, "bar", "print", LOOP_THRESHOLD).groupBy("track_id", "group_id").agg(F.min("bar").alias("bar"))
    pieces = firsts.join(spans, ["track_id", "bar"]).join(known, "track_id")
    name = F.concat(F.lit("bar"), _numbered("bar", F.greatest(F.lit(3), F.length(F.col("_lines").cast("string")))))
    folder = F.concat(F.lit("loops_"), F.round("bpm").cast("long").cast("string"), F.lit("bpm"))
    return pieces.select("track_id", folder.alias("folder"), name.alias("name"), "start", "end", F.lit(0.001).alias("fade_in"), F.lit(0.002).alias("fade_out"))


def _encoded_pieces(key: tuple, audio: np.ndarray, rate: int, parts: pd.DataFrame, bits: int) -> list[tuple]:
    """(track, folder/name.wav, content) of every piece, with its ramps; a piece from the first sample has none at its start."""
    out = []
    for p in parts.itertuples():
        x = audio[:, p.start : p.end].astype(np.float64)
        n = x.shape[1]
        up = 0 if p.start == 0 else min(n, int(p.fade_in * rate))
        down = min(n - up, int(p.fade_out * rate))
        x[:, :up] *= np.arange(up) / max(up, 1)
        x[:, n - down :] *= (np.arange(down) / max(down, 1))[::-1]
        out.append((key[0], f"{p.folder}/{p.name}.wav", encode_wav(x, rate, bits, f"{key[0]}/{p.name}")))
    return out


FILES = "track_id string, name string, content binary"


def cut_pieces(blocks: DataFrame, pieces: DataFrame, bits: int = 32) -> DataFrame:
    """(track_id, name, content): a WAV file for every piece, with its ramps, named folder/name.wav."""

    def run(key: tuple, own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        out = _encoded_pieces(key, joined(own), int(own["rate"].iloc[0]), parts, bits) if len(own) else []
        return pd.DataFrame(out, columns=["track_id", "name", "content"])

    return blocks.groupBy("track_id").cogroup(pieces.groupBy("track_id")).applyInPandas(run, FILES)


def scaled(pieces: DataFrame, ratio: float | Column, frames: str) -> DataFrame:
    """Pieces of the same audio at another rate, no longer than its ``frames``."""
    edge = lambda c: F.least(F.col(frames), F.round(F.col(c) * ratio).cast("long"))
    return pieces.withColumn("start", edge("start")).withColumn("end", edge("end"))


def device_files(blocks: DataFrame, pieces: DataFrame | None = None, rate: int = 48_000, same: float = 1e-4) -> DataFrame:
    """(track_id, name, content): 16-bit files at a sampler's rate, of each track (name is empty) and of its pieces.

    Both channels become their mean where they are as good as equal. A track is resampled once, and its pieces are cut from
    the copy at the same times, so they have as many channels as it has.
    """
    sizes = blocks.groupBy("track_id").agg(F.max(F.col("start_sample") + F.size("left")).alias("_n"), F.first("rate").alias("_rate"))
    ratio = F.lit(rate) / F.col("_rate")
    pieces = blocks.sparkSession.createDataFrame([], PIECES) if pieces is None else pieces
    placed = pieces.join(sizes, "track_id").withColumn("_frames", F.floor(F.col("_n") * ratio + 0.5))
    placed = scaled(placed, ratio, "_frames").drop("_n", "_rate", "_frames")

    def run(key: tuple, own: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        audio = resample(joined(own), float(own["rate"].iloc[0]), rate)
        if np.abs(audio[0] - audio[1]).max(initial=0) < same:
            audio = audio.mean(axis=0, keepdims=True)
        out = [(key[0], "", encode_wav(audio, rate, 16, str(key[0]))), *_encoded_pieces(key, audio, rate, parts, 16)]
        return pd.DataFrame(out, columns=["track_id", "name", "content"])

    return blocks.groupBy("track_id").cogroup(placed.groupBy("track_id")).applyInPandas(run, FILES)


def score_stems(reference: DataFrame, estimate: DataFrame) -> DataFrame:
    """(track_id, stem, sdr) over both channels and the samples that both have. Inputs: audio blocks with a ``stem``."""
    other = estimate.select("track_id", "stem", "block_no", F.col("left").alias("_l"), F.col("right").alias("_r"))
    both = reference.join(other, ["track_id", "stem", "block_no"])
    energy = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v.cast("double") * v)
    shorter = lambda x, y: F.slice(x, 1, F.least(F.size(x), F.size(y)))
    sums = both.select(
        "track_id", "stem",
        (energy(shorter(F.col("left"), F.col("_l"))) + energy(shorter(F.col("right"), F.col("_r")))).alias("_s"),
        (energy(residual(shorter(F.col("left"), F.col("_l")), shorter(F.col("_l"), F.col("left")))) + energy(residual(shorter(F.col("right"), F.col("_r")), shorter(F.col("_r"), F.col("right"))))).alias("_e"),
    )
    return sums.groupBy("track_id", "stem").agg((10 * F.log10(F.sum("_s") / F.greatest(F.sum("_e"), F.lit(1e-20)))).alias("sdr"))


def mean_scores(scores: DataFrame) -> DataFrame:
    """(stem, sdr): mean over tracks, and under the name "average" the mean over stems."""
    stems = scores.groupBy("stem").agg(F.avg("sdr").alias("sdr"))
    return stems.union(stems.agg(F.lit("average").alias("stem"), F.avg("sdr").alias("sdr")))
