"""Audio files as blocks of samples, read by ranges of bytes.

A data source for Spark: the driver only lists files and their sizes; a task has one or more ranges of files, reads the file's head, then the range's own
bytes, a block at a time. No task holds more than a block, however long the recording, and one that is stopped stops between two of them.
Small ranges share tasks, those of a file among different ones as far as there are some.

    spark.dataSource.register(AudioBlocks)
    spark.read.format("audio_blocks").option("path", folder).load()

Files lie where pyarrow finds them (local, HDFS, S3, GCS). For others, or other formats, see ``readers.read_audio``.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tempoframe.operators.signal import RATE

BLOCK, RANGE_BYTES = 65_536, 32 << 20
#: Ranges share tasks beyond so many, while a task has no more than RANGE_BYTES and so many of them.
TASKS, TASK_RANGES = 200, 2_000
SCHEMA = "path string, block long, first_sample long, samples array<float>, channels int, sample_rate int"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@dataclass
class Layout:
    """Where the samples of a file lie: from which byte, how many values, bytes of each."""

    offset: int
    values: int
    width: int
    channels: int
    rate: int
    floats: bool = False

    def decoded(self, raw: bytes) -> np.ndarray:
        if self.floats:
            return np.frombuffer(raw, "<f4")
        return pcm(raw, self.width)


def pcm(raw: bytes, width: int) -> np.ndarray:
    """Samples of 8 (unsigned), 16, 24 or 32 bits as floats below one."""
    if width == 1:
        return (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    if width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        return (((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / np.float32(1 << 23)).astype(np.float32)
    return (np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]) / np.float32(1 << (8 * width - 1))).astype(np.float32)


def layout(read: Callable[[int, int], bytes], size: int) -> Layout:
    """By the head of a RIFF file; anything else is little-endian mono floats. ``read``: place, number of bytes."""
    if read(0, 4) != b"RIFF":
        return Layout(0, size // 4, 4, 1, RATE, True)
    at, form = 12, None
    while at + 8 <= size:
        head = read(at, 8)
        name, length = head[:4], int.from_bytes(head[4:8], "little")
        if name == b"fmt ":
            form = read(at + 8, 16)
        elif name == b"data" and form is not None:
            channels, rate, width = int.from_bytes(form[2:4], "little"), int.from_bytes(form[4:8], "little"), int.from_bytes(form[14:16], "little") // 8
            length = min(length, size - at - 8)  # a head that was never brought up to date
            return Layout(at + 8, length // (width * channels) * channels, width, channels, rate)
        at += 8 + length + length % 2
    raise ValueError("no samples in this file")


def blocks_of(path: str, read: Callable[[int, int], bytes], size: int, block: int = BLOCK, part: int = 0, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """The blocks of one of so many equal parts of a file, one at a time."""
    own = layout(read, size)
    block = max(block // own.channels, 1) * own.channels  # whole frames
    total = -(-own.values // block)
    for k in range(total * part // parts, total * (part + 1) // parts):
        n = min(block, own.values - k * block)
        samples = pa.array([own.decoded(read(own.offset + k * block * own.width, n * own.width))], pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k]), pa.array([k * block]), samples, pa.array([own.channels], pa.int32()), pa.array([own.rate], pa.int32())], NAMES)


@dataclass
class FileRange:
    path: str
    size: int
    part: int
    parts: int


@dataclass
class Ranges(InputPartition):
    """What a task reads."""

    ranges: list[FileRange]


class BlockReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.pattern = options["path"], options.get("pattern", "*")
        self.block, self.range_bytes = int(options.get("block", BLOCK)), int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Ranges]:
        system, path = fs.FileSystem.from_uri(self.folder) if "://" in self.folder else (fs.LocalFileSystem(), self.folder)
        found = [system.get_file_info(path)]
        if found[0].type == fs.FileType.Directory:
            found = [f for f in system.get_file_info(fs.FileSelector(path, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern)]
        out = []
        for f in sorted(found, key=lambda f: f.path):
            parts = max(1, -(-f.size // self.range_bytes))
            out += [FileRange(f.path, f.size, k, parts) for k in range(parts)]
        tasks = max(min(len(out), TASKS), -(-sum(f.size for f in found) // RANGE_BYTES), -(-len(out) // TASK_RANGES))
        return [Ranges(own) for k in range(tasks) if (own := out[k::tasks])]

    def read(self, partition: Ranges) -> Iterator[pa.RecordBatch]:
        system = fs.FileSystem.from_uri(self.folder)[0] if "://" in self.folder else fs.LocalFileSystem()
        for own in partition.ranges:
            with system.open_input_file(own.path) as source:

                def read(at: int, n: int, source=source) -> bytes:
                    source.seek(at)
                    return source.read(n)

                yield from blocks_of(own.path, read, own.size, self.block, own.part, own.parts)


class AudioBlocks(DataSource):
    """Options: path (a file or folder), pattern, block (samples), rangeBytes (of a task)."""

    @classmethod
    def name(cls) -> str:
        return "audio_blocks"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BlockReader:
        return BlockReader({k.lower(): v for k, v in self.options.items()})


def content_blocks(files: DataFrame, block: int = BLOCK) -> DataFrame:
    """The same of files whose bytes are a column (path, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                data = memoryview(content.as_buffer())
                yield from blocks_of(path, lambda at, n, data=data: bytes(data[at : at + n]), len(data), block)

    return files.select("path", "content").mapInArrow(run, SCHEMA)
