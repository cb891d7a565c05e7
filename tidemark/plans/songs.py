"""A collection of songs from files to stems, kits, loops and the files of all of them."""

from __future__ import annotations

import functools
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import title_prefix
from tidemark.plans import stems as T
from tidemark.plans.tables import settled
from tidemark.plans.transcription import Transcription
from tidemark.sources.wav import encoded, staged, write_files


@dataclass(frozen=True)
class Split:
    """What a run gives: audio blocks with a ``stem``, bar lines, and pieces with a ``stem``; None if not asked for."""

    stems: DataFrame
    grid: DataFrame | None
    pieces: DataFrame | None


def split(
    mix: DataFrame,
    vocals: Callable[[], T.Separator],
    horns: Callable[[], T.Separator],
    band: Mapping[str, Callable[[], T.Separator]] | T.Core,
    options: T.Options = T.Options(),
    transcription: Transcription | None = None,
    chunk: int = 352_800,
    block: int = T.BLOCK,
    keep: Callable[[str, DataFrame], DataFrame] = lambda name, stem: settled(stem),
) -> Split:
    """Peel vocals off the mix and horns off what is left, hear the other stems in the rest, and cut what the options ask for.

    A band is a separator for each stem, or one core for all of them, whose vocals and horns are not used.
    Bar lines come from the transcription, moved to drum attacks, unless a tempo is given; without either from the drums.
    The mix and what it is without vocals are stems, too. Only what the options need is made. Every stem that a model makes goes through ``keep``,
    by name, which writes it as a checkpoint unless told otherwise: stems are read several times, and a model should hear them once.
    """
    hear = functools.partial(T.separate, chunk=chunk, block=block)
    sung = keep("vocals", hear(mix, vocals))
    instrumental = T.subtract(mix, sung)
    blown = keep("horns", hear(instrumental, horns))
    rest = T.subtract(instrumental, blown)
    parts = {"mix": mix.select(*sung.columns), "vocals": sung, "instrumental": instrumental.select(*sung.columns), "horns": blown}
    if isinstance(band, T.Core):
        others = [name for name in band.sources if name not in parts]
        heard = keep("band", T.separate_all(rest, band, block)).where(F.col("stem").isin(others))
        tables = [df.withColumn("stem", F.lit(name)) for name, df in parts.items()] + [heard]
        parts |= {name: heard.where(F.col("stem") == name).drop("stem") for name in others}
    else:
        parts |= {name: keep(name, hear(rest, load)) for name, load in band.items()}
        tables = [df.withColumn("stem", F.lit(name)) for name, df in parts.items()]
    named = functools.reduce(DataFrame.unionByName, tables)
    grid, pieces = None, []
    if options.loops:
        if transcription is not None and options.bpm is None:
            lines = transcription.grid(T.attacks(parts["drums"]), float(mix.select("rate").first()["rate"]))
            listed = lines.groupBy("track_id").agg(F.array_sort(F.collect_list("sample")).alias("downbeats"))
            grid = listed.join(transcription.bpm, "track_id").select("track_id", "bpm", "downbeats")
        else:
            grid = T.grids(parts["drums"], options.bpm)
        grid = settled(grid)  # a row for each track, read by every stem's loops
        pieces += [T.loops(parts[s], grid, options.bars).withColumn("stem", F.lit(s)) for s in sorted(options.loops)]
    pieces += [T.kits(parts[s]).withColumn("stem", F.lit(s)) for s in sorted(options.kit)]
    return Split(named, grid, settled(functools.reduce(DataFrame.unionByName, pieces)) if pieces else None)


def _named(prefix: Column) -> Column:
    """folder/name.wav of a piece as prefix_folder/prefix_name.wav."""
    return F.concat(prefix, F.lit("_"), F.replace(F.col("name"), F.lit("/"), F.concat(F.lit("/"), prefix, F.lit("_"))))


def files(result: Split, device: bool = False) -> DataFrame:
    """(name, content): song/stem.wav for every stem and song/stem_folder/stem_piece.wav for every piece.

    A sampler's copies are in song/device, under names that begin with the song's: prefix_stem.wav and prefix_stem_folder/prefix_stem_piece.wav.
    """
    stems = [r["stem"] for r in result.stems.select("stem").distinct().collect()]  # one of a closed set of names
    out = []
    for stem in sorted(stems):
        own = result.stems.where(F.col("stem") == stem).drop("stem")
        pieces = None if result.pieces is None else result.pieces.where(F.col("stem") == stem).drop("stem")
        out.append(encoded(own).select(F.concat("track_id", F.lit(f"/{stem}.wav")).alias("name"), "content"))
        if pieces is not None:
            cut = T.cut_pieces(own, pieces)
            out.append(cut.select(F.concat_ws("/", "track_id", _named(F.lit(stem))).alias("name"), "content"))
        if device:
            prefix = F.concat_ws("_", title_prefix(F.col("track_id")), F.lit(stem))
            name = F.when(F.col("name") == "", F.concat(prefix, F.lit(".wav"))).otherwise(_named(prefix))
            out.append(T.device_files(own, pieces).select(F.concat_ws("/", "track_id", F.lit("device"), name).alias("name"), "content"))
    return functools.reduce(DataFrame.union, out)


def write(result: Split, folder: str, device: bool = False) -> list[str]:
    """All files of a split, or none after an error; the songs' folders by name, numbered if taken."""
    with staged(folder) as (stage, names):
        write_files(files(result, device), stage)
    return names
