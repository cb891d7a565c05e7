"""WAV files as tables of audio blocks, and back."""

from __future__ import annotations

import math
import struct
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Samples of a block; a track is never one row, nor a row for each sample.
BLOCK = 1 << 16

AUDIO_BLOCK = T.StructType([
    T.StructField("track_id", T.StringType()),
    T.StructField("rate", T.IntegerType()),
    T.StructField("block_no", T.LongType()),
    T.StructField("start_sample", T.LongType()),
    T.StructField("left", T.ArrayType(T.FloatType())),
    T.StructField("right", T.ArrayType(T.FloatType())),
])


def decode_wav(data: bytes) -> tuple[int, np.ndarray]:
    """(rate, channels x samples) of a RIFF file of 16-bit or 32-bit float samples; chunks of odd length are padded."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= len(data):
        kind, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = data[at + 8 : at + 8 + size]
        if kind == b"fmt ":
            form = struct.unpack_from("<HHIIHH", body)
            if form[0] == 0xFFFE:
                form = (struct.unpack_from("<H", body, 24)[0], *form[1:])
        elif kind == b"data" and form:
            code, channels, rate, _, _, bits = form
            if (code, bits) == (1, 16):
                x = np.frombuffer(body[: len(body) // 2 * 2], dtype="<i2").astype(np.float32) / 32768
            elif (code, bits) == (3, 32):
                x = np.frombuffer(body[: len(body) // 4 * 4], dtype="<f4")
            else:
                raise ValueError(f"WAV samples of format {code} with {bits} bits are not read")
            return rate, x[: len(x) // channels * channels].reshape(-1, channels).T
        at += 8 + size + size % 2
    raise ValueError("a WAV file without samples")


class Dither:
    """Triangular noise for each sample of a file, from a generator that can start at any place.

    The generator shifts and adds modulo two (by 13, 7 and 17 places of 64 bits), so a step is a matrix over bits, and n steps are a product of its
    powers of two: a block's noise is made without that of the blocks before it. Channels follow each other, two numbers a sample.
    """

    _jumps: list[np.ndarray] = []

    def __init__(self, name: str, frames: int):
        self.seed, self.frames = zlib.crc32(name.encode()) << 32 | zlib.adler32(name.encode()) | 1, frames

    @staticmethod
    def step(state: np.ndarray) -> np.ndarray:
        state = state ^ (state << np.uint64(13))
        state ^= state >> np.uint64(7)
        return state ^ (state << np.uint64(17))

    @staticmethod
    def times(matrix: np.ndarray, states: np.ndarray) -> np.ndarray:
        """A matrix, as the images of the 64 bits, on states."""
        out = np.zeros_like(states)
        for bit in range(64):
            out ^= matrix[bit] * ((states >> np.uint64(bit)) & np.uint64(1))
        return out

    @classmethod
    def jump(cls, power: int) -> np.ndarray:
        """The matrix of two to the ``power`` steps."""
        while len(cls._jumps) <= power:
            last = cls._jumps[-1] if cls._jumps else None
            cls._jumps.append(cls.step(np.uint64(1) << np.arange(64, dtype=np.uint64)) if last is None else cls.times(last, last))
        return cls._jumps[power]

    def states(self, first: int, count: int) -> np.ndarray:
        """The states behind steps ``first + 1`` to ``first + count``, doubling what is known of them."""
        one = np.array([self.seed], dtype=np.uint64)
        n, power = first + 1, 0
        while n:
            if n & 1:
                one = self.times(self.jump(power), one)
            n, power = n >> 1, power + 1
        power = 0
        while len(one) < count:
            one = np.concatenate([one, self.times(self.jump(power), one)])
            power += 1
        return one[:count]

    def noise(self, channel: int, first: int, count: int) -> np.ndarray:
        """What is added to ``count`` samples of a channel from sample ``first`` on, in steps of 16 bits."""
        unit = (self.states(2 * (channel * self.frames + first), 2 * count) >> np.uint64(40)).astype(np.float64) / (1 << 24)
        return unit[::2] + unit[1::2] - 1


def quantised(audio: np.ndarray, dither: Dither, first: int) -> bytes:
    """16-bit samples, from sample ``first`` of their file on."""
    noise = np.stack([dither.noise(c, first, audio.shape[1]) for c in range(len(audio))]) if audio.shape[1] else audio
    return np.clip(np.floor(audio.astype(np.float64) * 32767 + noise + 0.5), -32768, 32767).T.astype("<i2").tobytes()


def wav_header(rate: int, channels: int, frames: int, bits: int) -> bytes:
    """What stands before the samples of a file of floats or of 16 bits."""
    width = channels * bits // 8
    form = struct.pack("<HHIIHH", 1 if bits == 16 else 3, channels, rate, rate * width, width, bits)
    return b"RIFF" + struct.pack("<I", 36 + frames * width) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", frames * width)


def encode_wav(audio: np.ndarray, rate: int, bits: int = 32, name: str = "") -> bytes:
    """A RIFF file of 32-bit floats, or of 16 bits with triangular dither that depends on ``name`` and a sample's place alone."""
    channels, frames = audio.shape
    body = quantised(audio, Dither(name, frames), 0) if bits == 16 else np.ascontiguousarray(audio.T, dtype="<f4").tobytes()
    return wav_header(rate, channels, frames, bits) + body


def stereo(audio: np.ndarray) -> np.ndarray:
    """Two channels: a single one twice, the first two of more."""
    return np.vstack([audio, audio]) if len(audio) == 1 else audio[:2]


def resample_part(part: np.ndarray, begin: int, first: int, last: int, source: float, target: float, taps: int = 32) -> np.ndarray:
    """Samples ``first`` to ``last`` of tracks at another rate, by windowed-sinc interpolation; beyond the track is silence.

    part: channels x samples of the tracks from sample ``begin`` on, with all that the kernel reaches or up to the track's ends.
    """
    cut = min(1.0, target / source)
    reach = math.ceil(taps / cut)
    at = np.arange(first, last) * (source / target)
    base = np.floor(at).astype(np.int64)
    low, high = int(base[0]) - reach + 1, int(base[-1]) + reach + 1
    held = part[:, max(0, low - begin) : max(0, high - begin)].astype(np.float64)
    padded = np.pad(held, ((0, 0), (max(0, begin - low), 0)))
    padded = np.pad(padded, ((0, 0), (0, max(0, high - low - padded.shape[1]))))
    out = np.zeros((len(part), last - first), dtype=np.float32)
    for k in range(-reach + 1, reach + 1):
        d = at - (base + k)
        w = np.sinc(d * cut) * cut * np.where(np.abs(d) < reach, 0.5 + 0.5 * np.cos(np.pi * d / reach), 0)
        out += (padded[:, base + k - low] * w).astype(np.float32)
    return out


def resample(audio: np.ndarray, source: float, target: float, taps: int = 32) -> np.ndarray:
    """Tracks at another rate; the input itself if the rates agree or it is empty."""
    if source == target or not audio.shape[1]:
        return audio
    n = math.floor(audio.shape[1] * target / source + 0.5)
    return np.concatenate([resample_part(audio, 0, a, min(n, a + (1 << 15)), source, target, taps) for a in range(0, n, 1 << 15)], axis=1)


def read_wav(spark: SparkSession, path: str, rate: int | None = None, block: int = BLOCK) -> DataFrame:
    """Stereo blocks of every WAV file under ``path``, at ``rate`` if it is given; track_id is the file's name without ending."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["track_id"], batch["content"], strict=True):
                own, audio = decode_wav(content)
                audio = resample(stereo(audio), own, rate or own)
                for k, at in enumerate(range(0, audio.shape[1], block)):
                    left, right = (c[at : at + block].astype(np.float32) for c in audio)
                    yield pd.DataFrame({"track_id": [name], "rate": [rate or own], "block_no": [k], "start_sample": [at], "left": [left], "right": [right]})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.wav").load(path)
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.wav$", "")
    return files.select(name.alias("track_id"), "content").mapInPandas(run, AUDIO_BLOCK)


def joined(rows: pd.DataFrame) -> np.ndarray:
    """Channels x samples of one track's blocks."""
    rows = rows.sort_values("block_no")
    return np.vstack([np.concatenate(list(rows[c])) if len(rows) else np.zeros(0, np.float32) for c in ("left", "right")]).astype(np.float32)


def encoded(blocks: DataFrame, bits: int = 32) -> DataFrame:
    """(track_id, content): a WAV file for each track."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"track_id": [key[0]], "content": [encode_wav(joined(rows), int(rows["rate"].iloc[0]), bits, str(key[0]))]})

    return blocks.groupBy("track_id").applyInPandas(run, "track_id string, content binary")


def write_files(files: DataFrame, folder: str, name: str = "name", content: str = "content") -> None:
    """Write each row's bytes to ``folder/name`` from the executors, over the file system that Spark has for ``folder``'s scheme.

    Local paths must be on storage that all executors share.
    """
    import pyarrow.fs as pafs

    def put(rows: Iterator) -> None:
        system, root = pafs.FileSystem.from_uri(folder)
        for row in rows:
            path = f"{root.rstrip('/')}/{row[name]}"
            system.create_dir(path.rsplit("/", 1)[0], recursive=True)
            with system.open_output_stream(path) as f:
                f.write(bytes(row[content]))

    files.select(name, content).foreachPartition(put)


@contextmanager
def staged(folder: str) -> Iterator[tuple[str, list[str]]]:
    """A folder beside the results, whose entries move into ``folder`` at the end, numbered if their names are taken; after an error it is deleted with all in it.

    Gives the folder's path, and a list that names the entries once they have moved.
    """
    import pyarrow.fs as pafs

    system, root = pafs.FileSystem.from_uri(folder)
    root, own, names = root.rstrip("/"), f"_run-{uuid.uuid4().hex}", []
    taken = lambda name: system.get_file_info(f"{root}/{name}").type != pafs.FileType.NotFound
    try:
        yield f"{folder.rstrip('/')}/{own}", names
        for entry in system.get_file_info(pafs.FileSelector(f"{root}/{own}", allow_not_found=True)):
            name, number = entry.base_name, 1
            while taken(name):
                number += 1
                name = f"{entry.base_name} {number}"
            system.move(entry.path, f"{root}/{name}")
            names.append(name)
    finally:
        if taken(own):
            system.delete_dir(f"{root}/{own}")
