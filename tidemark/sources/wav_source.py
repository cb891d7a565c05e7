"""WAV files as a data source: ``spark.read.format("wav")`` reads ranges of a file in tasks of their own, ``df.write.format("wav")`` commits or leaves nothing.

Register it with ``spark.dataSource.register(WavSource)``. Both directions hold a block at a time. Paths are those of pyarrow's file systems.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StructField, StructType

from tidemark.operators.cells import beside
from tidemark.sources.wav import AUDIO_BLOCK, BLOCK, Dither, quantised, stereo, wav_header

#: Blocks of a partition, if the ``blocks`` option does not say: 16 of 65,536 samples of two floats are 8 MB.
BLOCKS = 16


@dataclass
class Form:
    """Where a file's samples are, and what they look like."""

    rate: int
    channels: int
    kind: str
    at: int
    frames: int

    @property
    def width(self) -> int:
        return self.channels * np.dtype(self.kind).itemsize


def form_of(file: pa.NativeFile, size: int) -> Form:
    """The form of an open file, from the heads of its chunks; its samples are not read."""
    if size < 12 or file.read(4) != b"RIFF" or file.read(8)[4:] != b"WAVE":
        raise ValueError("not a WAV file")
    at, form = 12, None
    while at + 8 <= size:
        file.seek(at)
        kind, length = struct.unpack("<4sI", file.read(8))
        if kind == b"fmt ":
            body = file.read(min(length, 26))
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", body)
            code = struct.unpack_from("<H", body, 24)[0] if code == 0xFFFE else code
            named = {(1, 16): "<i2", (3, 32): "<f4"}.get((code, bits))
            if named is None:
                raise ValueError(f"WAV samples of format {code} with {bits} bits are not read")
            form = (rate, channels, named)
        elif kind == b"data" and form:
            there = min(length, size - at - 8)
            return Form(*form, at + 8, there // (form[1] * np.dtype(form[2]).itemsize))
        at += 8 + length + length % 2
    raise ValueError("a WAV file without samples")


class Range(InputPartition):
    def __init__(self, path: str, name: str, form: Form, first: int, last: int):
        self.path, self.name, self.form, self.first, self.last = path, name, form, first, last


class WavReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.block, self.blocks = int(options.get("block", BLOCK)), int(options.get("blocks", BLOCKS))

    def partitions(self) -> list[Range]:
        """Every file in ranges of whole blocks; of files only the heads are read."""
        system, root = pafs.FileSystem.from_uri(self.root)
        info = system.get_file_info(root)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.root)
        files = [info] if info.is_file else [f for f in system.get_file_info(pafs.FileSelector(root)) if f.is_file and f.base_name.endswith(".wav")]
        out = []
        for f in sorted(files, key=lambda f: f.path):
            with system.open_input_file(f.path) as opened:
                form = form_of(opened, f.size)
            step = self.block * self.blocks
            out += [Range(f.path, f.base_name.removesuffix(".wav"), form, a, min(a + step, form.frames)) for a in range(0, form.frames, step)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = pafs.FileSystem.from_uri(self.root)
        form = partition.form
        with system.open_input_file(partition.path) as file:
            for first in range(partition.first, partition.last, self.block):
                n = min(self.block, partition.last - first)
                file.seek(form.at + first * form.width)
                x = np.frombuffer(file.read(n * form.width), dtype=form.kind).reshape(-1, form.channels).T
                left, right = stereo(x.astype(np.float32) / 32768 if form.kind == "<i2" else x)
                columns = [[partition.name], [form.rate], [first // self.block], [first], [np.ascontiguousarray(left)], [np.ascontiguousarray(right)]]
                kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), *[pa.list_(pa.float32())] * 2]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], AUDIO_BLOCK.names)


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WavWriter(DataSourceWriter):
    """Files grow in a folder of this write's own, and move to their places when every task is done; an aborted write deletes it."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.folder, self.bits, self.overwrite = options["path"].rstrip("/"), int(options.get("bits", 32)), overwrite
        self.stage = f"{self.folder}/_writing-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, stage = pafs.FileSystem.from_uri(self.stage)
        names: list[str] = []
        file, track, place, dither = None, None, 0, None
        try:
            for row in iterator:
                if file is None or row["track_id"] != track:
                    if file is not None:
                        file.close()
                    track, place = row["track_id"], 0
                    names.append(f"{track}.wav")
                    system.create_dir(stage, recursive=True)
                    file = system.open_output_stream(f"{stage}/{track}.wav")
                    file.write(wav_header(int(row["rate"]), 2, row["n"], self.bits))
                    dither = Dither(str(track), row["n"])
                if row["start_sample"] != place:
                    raise ValueError(f"{track}: a block begins at {row['start_sample']}, not at {place}; use wav_source.write")
                audio = np.array([row["left"], row["right"]], dtype=np.float32)
                file.write(quantised(audio, dither, place) if self.bits == 16 else np.ascontiguousarray(audio.T, dtype="<f4").tobytes())
                place += audio.shape[1]
        finally:
            if file is not None:
                file.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = pafs.FileSystem.from_uri(self.folder)
        _, stage = pafs.FileSystem.from_uri(self.stage)
        names = [name for m in messages if m for name in m.names]
        there = [name for name in names if system.get_file_info(f"{folder}/{name}").type != pafs.FileType.NotFound]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(f"{self.folder}/{there[0]}")
        for name in names:
            system.move(f"{stage}/{name}", f"{folder}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, stage = pafs.FileSystem.from_uri(self.stage)
        if system.get_file_info(stage).type != pafs.FileType.NotFound:
            system.delete_dir(stage)


class WavSource(DataSource):
    """Options: path; reading: block (samples of a block), blocks (of a partition); writing: bits (32, or 16 with dither)."""

    @classmethod
    def name(cls) -> str:
        return "wav"

    def schema(self) -> StructType:
        return AUDIO_BLOCK

    def reader(self, schema: StructType) -> WavReader:
        return WavReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WavWriter:
        return WavWriter(self.options, overwrite)


def write(blocks: DataFrame, folder: str, bits: int = 32, overwrite: bool = False) -> None:
    """A file for every track of audio blocks. A track's blocks come to one task in order, which appends them one by one."""
    blocks.sparkSession.dataSource.register(WavSource)
    sizes = blocks.groupBy("track_id").agg(F.max(F.col("start_sample") + F.size("left")).alias("n"))
    rows = beside(blocks.select(AUDIO_BLOCK.names), sizes, ["track_id"]).repartition("track_id").sortWithinPartitions("track_id", "start_sample")
    rows = rows.select(*AUDIO_BLOCK.names, "n").to(StructType([*AUDIO_BLOCK.fields, StructField("n", LongType())]))
    rows.write.format("wav").mode("overwrite" if overwrite else "append").option("path", folder).option("bits", bits).save()
