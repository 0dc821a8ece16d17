"""Token ids in seekable files: independent zstandard frames, an index of documents and a trailing seek table.

A file is a plain zstandard stream: a document's ids (little-endian, unsigned 32 bits) are one frame, or several of FRAME bytes
for a long one. A skippable frame follows with (doc_id, known, frames) for each document, and another with the compressed size,
size and checksum (low half of XXH64) of each frame, laid out as the public seekable format has it. A reader
takes the footer, the table and the index, and then only the frames it wants.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .bpe import Encoder
from .common import cut, shared_path

FRAME = 1 << 20
#: The magic numbers of skippable frames and of the seekable format.
INDEX_MAGIC, SEEK_MAGIC, FOOTER_MAGIC, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
_ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
_DOC = np.dtype([("doc_id", "<i8"), ("known", "u1"), ("frames", "<u4")])


def _u4(*values: int) -> bytes:
    return np.array(values, "<u4").tobytes()


class Writer:
    """Appends documents to an open binary file; close() writes index and seek table."""

    def __init__(self, out, level: int = 3):
        self.out, self.pack = out, zstandard.ZstdCompressor(level=level, write_content_size=True).compress
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int]] = []
        self.n_ids = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        before = len(self.entries)
        for i in range(0, len(ids), FRAME):
            part = ids[i : i + FRAME]
            made = self.pack(part)
            self.out.write(made)
            self.entries.append((len(made), len(part), xxh64_intdigest(part) & 0xFFFFFFFF))
        self.docs.append((doc_id or 0, doc_id is not None, len(self.entries) - before))
        self.n_ids += len(ids) // 4

    def close(self) -> None:
        index = np.array(self.docs, _DOC).tobytes()
        table = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(_u4(INDEX_MAGIC, len(index)) + index)
        self.out.write(_u4(SEEK_MAGIC, len(table) + 9) + table + _u4(len(self.entries)) + bytes([CHECKSUMS]) + _u4(FOOTER_MAGIC))


class Reader:
    """Documents of one open, seekable binary file."""

    def __init__(self, file):
        self.file, size = file, file.size()
        file.seek(size - 9)
        foot = file.read(9)
        if np.frombuffer(foot[5:], "<u4")[0] != FOOTER_MAGIC or foot[4] != CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        n = int(np.frombuffer(foot[:4], "<u4")[0])
        file.seek(size - 9 - n * _ENTRY.itemsize)
        self.entries = np.frombuffer(file.read(n * _ENTRY.itemsize), _ENTRY)
        self.at = np.append(0, np.cumsum(self.entries["packed"], dtype=np.int64))
        file.seek(int(self.at[-1]))
        magic, length = np.frombuffer(file.read(8), "<u4").tolist()
        if magic != INDEX_MAGIC:
            raise ValueError("the index of documents is missing")
        self.docs = np.frombuffer(file.read(length), _DOC)
        self.first = np.append(0, np.cumsum(self.docs["frames"], dtype=np.int64))
        self.unpack = zstandard.ZstdDecompressor().decompress

    def ids(self, i: int) -> bytes:
        """Of the i-th document; a wrong checksum raises."""
        out = []
        for k in range(int(self.first[i]), int(self.first[i + 1])):
            self.file.seek(int(self.at[k]))
            part = self.unpack(self.file.read(int(self.entries["packed"][k])), max_output_size=int(self.entries["size"][k]))
            if xxh64_intdigest(part) & 0xFFFFFFFF != self.entries["check"][k]:
                raise ValueError(f"checksum of frame {k}")
            out.append(part)
        return b"".join(out)

    def doc_id(self, i: int) -> int | None:
        return int(self.docs["doc_id"][i]) if self.docs["known"][i] else None

    def find(self, doc_id: int) -> list[bytes]:
        """All documents of that id."""
        return [self.ids(i) for i in np.flatnonzero((self.docs["doc_id"] == doc_id) & (self.docs["known"] == 1)).tolist()]


def _write(folder: str, tokenizer: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encoder, end = TaskContext.get().partitionId(), Encoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, draft = f"{path}/part-{part:06d}.zst", f"{path}/_{part:06d}-{uuid.uuid4().hex}"
        with store.open_output_stream(draft) as out:
            w = Writer(out)
            for b in batches:
                at = 0
                for ids, ends in encoder.encode(b.column(1)):
                    raw, start = ids.astype("<u4").tobytes(), 0
                    for doc_id, stop in zip(b.column(0).slice(at, len(ends)).to_pylist(), (4 * ends).tolist(), strict=True):
                        w.add(doc_id, raw[start:stop] + end)
                        start = stop
                    at += len(ends)
            w.close()
        if w.docs:
            store.move(draft, name)  # a repeated task replaces the file as a whole
            yield pa.RecordBatch.from_pydict({"part": [part], "name": [name.rsplit("/", 1)[1]], "n_docs": [len(w.docs)], "n_ids": [w.n_ids]})
        else:
            store.delete_file(draft)

    return run


def write(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None, file_bytes: int = 16 << 20) -> tuple[str, DataFrame]:
    """Writes all texts in ascending doc_id order; returns the folder, and (part, name, n_docs, n_ids) of its files.

    The folder (a URI that pyarrow.fs opens: file, s3, gs, hdfs) must be shared by all executors. Texts are dealt by range
    of doc_id and a hash of the text, so a repeated doc_id is split too, to as many files as hold about file_bytes of text each. Null doc_ids
    come first, null texts hold the end id alone; texts of any length are taken whole. Repeated rows are documents of their own. Other columns
    are ignored. An empty table makes no file.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(8))).first()[0] or 0
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    dealt = rows.repartitionByRange(max(1, -(-int(size) // file_bytes)), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    return folder, cut(dealt.mapInArrow(_write(folder, tokenizer, end_id), "part long, name string, n_docs long, n_ids long"), "tokens")


def _read(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with store.open_input_file(f"{path}/{name}") as file:
                    r, rows, size = Reader(file), [], 0
                    for i in range(len(r.docs)):
                        ids = r.ids(i)
                        rows.append((r.doc_id(i), start, ids))
                        start, size = start + len(ids) // 4, size + len(ids)
                        if size >= 4 << 20 or i + 1 == len(r.docs):
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["doc_id", "start", "ids"])
                            rows, size = [], 0

    return run


def read(spark: SparkSession, folder: str, files: DataFrame) -> DataFrame:
    """(doc_id, start, ids binary) of every document; start counts the ids of all documents before it."""
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row for each file
    placed = files.select("name", before.alias("start"))
    tasks = max(1, files.count())
    return placed.repartition(tasks, "name").mapInArrow(_read(folder), "doc_id long, start long, ids binary")
