"""Lines of text in block-compressed gzip, read in as many tasks as its blocks allow."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A block's first bytes (gzip with one extra field), the subfield that holds its size, and the largest size.
MAGIC, FIELD, LARGEST = b"\x1f\x8b\x08\x04", b"BC\x02\x00", 1 << 16
#: Compressed bytes that one task reads, and lines of one batch.
SPLIT, LINES = 32 << 20, 4096


def _open(path: str):
    system, name = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, name


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files in a folder."""
    system, name = _open(path)
    info = system.get_file_info(name)
    found = system.get_file_info(fs.FileSelector(name)) if info.type == fs.FileType.Directory else [info]
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def size_of(head: bytes) -> int | None:
    """The size of the block that starts with `head`, or None if none starts there."""
    if len(head) < 18 or head[:4] != MAGIC:
        return None
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 6 <= min(12 + extra, len(head)):
        if head[at : at + 4] == FIELD:
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + struct.unpack("<H", head[at + 2 : at + 4])[0]
    return None


def is_blocked(path: str) -> bool:
    """Whether the first file there is compressed in blocks."""
    found = files(path)
    if not found:
        return False
    system, name = _open(found[0][0])
    with system.open_input_file(name) as file:
        return size_of(file.read(64)) is not None


def first_block(data: bytes, size: int) -> int | None:
    """Where in `data`, from a file's `size` bytes on, the first block starts: a place that looks like one and is followed by another, or by the end of the file."""
    at = data.find(MAGIC)
    while at >= 0:
        own = size_of(data[at : at + 64])
        if own is not None and (at + own == size or size_of(data[at + own : at + own + 64]) is not None):
            return at
        at = data.find(MAGIC, at + 1)
    return None


class _Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int, size: int):
        self.path, self.start, self.stop, self.size = path, start, stop, size


def lines_of(path: str, start: int, stop: int, size: int) -> Iterator[bytes]:
    """The lines that belong to a range of a file's bytes: those that begin after the first end of line in its blocks, and the first that begins behind them. At the start of the file, all."""
    system, name = _open(path)
    with system.open_input_file(name) as file:
        at = start
        if start:
            found = first_block(file.read_at(min(3 * LARGEST, size - start), start), size - start)
            if found is None or start + found >= stop:
                return
            at = start + found
        left, whole = b"", not start  # whole: the next line is this range's own
        ended = False
        while at < size:
            beyond = at >= stop
            head = file.read_at(min(LARGEST, size - at), at)
            own = size_of(head)
            if own is None:
                raise ValueError(f"{path}: no block at {at}")
            text = zlib.decompress(head[:own], wbits=31)
            at += own
            parts = (left + text).split(b"\n")
            left = parts.pop()
            for line in parts:
                if whole:
                    yield line
                whole = True
                if beyond:
                    ended = True
                    break
            if ended:
                return
        if left and whole:
            yield left


class _Reader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self) -> list[InputPartition]:
        return [_Range(p, a, min(a + self.split, n), n) for p, n in files(self.path) for a in range(0, n, self.split)] or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for line in lines_of(partition.path, partition.start, partition.stop, partition.size) if partition.size else ():
            held.append(line)
            if len(held) >= LINES:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)


def _batch(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x.removesuffix(b"\r").decode() for x in held], pa.string())], ["value"])


class BlockedText(DataSource):
    """Format `blocked_text`: (value) lines of block-compressed files; option `split`: compressed bytes of a task."""

    @classmethod
    def name(cls) -> str:
        return "blocked_text"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], int(self.options.get("split", SPLIT)))


def read(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """(value) lines, in as many tasks as the file has ranges of `split` bytes."""
    spark.dataSource.register(BlockedText)
    return spark.read.format("blocked_text").option("split", split).load(path)
