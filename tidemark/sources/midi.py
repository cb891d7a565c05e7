"""Standard MIDI files (format 1) from tables of notes."""

from __future__ import annotations

import struct
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# At the tempo written to the file (half a second a quarter note), a second is two quarter notes.
TICKS_PER_QUARTER, TICKS_PER_SECOND, TEMPO_US = 960, 1920, 500_000

NOTES = "track_id string, part string, pitch int, start double, end double, velocity int"


def quantity(value: int) -> bytes:
    """Seven bits a byte, the highest first, all but the last marked."""
    out = [value & 0x7F]
    while value := value >> 7:
        out.append(value & 0x7F | 0x80)
    return bytes(reversed(out))


def _track(events: bytes) -> bytes:
    body = events + b"\x00\xff\x2f\x00"
    return b"MTrk" + struct.pack(">I", len(body)) + body


def encode_midi(parts: Sequence[tuple[str, pd.DataFrame]]) -> bytes:
    """A tempo track and a track for each part; at one tick notes end before others begin. Channel 10, for drums, is left out."""
    out = b"MThd" + struct.pack(">IHHH", 6, 1, len(parts) + 1, TICKS_PER_QUARTER)
    out += _track(b"\x00\xff\x51\x03" + struct.pack(">I", TEMPO_US)[1:])
    for k, (name, notes) in enumerate(parts):
        channel = k + (k >= 9)
        title = name.encode()
        body = b"\x00\xff\x03" + quantity(len(title)) + title + bytes([0x00, 0xC0 | channel, 0])
        tick = lambda s: int(s * TICKS_PER_SECOND + 0.5)
        messages = [(tick(n.start), 1, int(n.pitch), int(n.velocity)) for n in notes.itertuples()]
        messages += [(tick(n.end), 0, int(n.pitch), 0) for n in notes.itertuples()]
        now = 0
        for at, on, pitch, velocity in sorted(messages):
            body += quantity(at - now) + bytes([(0x90 if on else 0x80) | channel, pitch, velocity])
            now = at
        out += _track(body)
    return out


def messages(notes: DataFrame, key: Sequence[str] = ("track_id", "part")) -> DataFrame:
    """(key, message_no, tick, on, pitch, velocity): what begins and ends, in the order of a file; at one tick ends come first."""
    tick = lambda c: F.floor(F.col(c) * TICKS_PER_SECOND + 0.5)
    ends = F.struct(tick("end").alias("tick"), F.lit(0).alias("on"), "pitch", F.lit(0).alias("velocity"))
    each = notes.select(*key, F.explode(F.array(F.struct(tick("start").alias("tick"), F.lit(1).alias("on"), "pitch", "velocity"), ends)).alias("_m"))
    rows = each.select(*key, "_m.*")
    return rows.withColumn("message_no", F.row_number().over(Window.partitionBy(*key).orderBy("tick", "on", "pitch", "velocity")))


def midi_files(notes: DataFrame, parts: Sequence[str]) -> DataFrame:
    """(track_id, content): one file for each song with the named parts, in that order, empty ones too."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track_id": [key[0]], "content": [encode_midi([(p, rows[rows["part"] == p]) for p in parts])]})

    return notes.groupBy("track_id").applyInPandas(run, "track_id string, content binary")
