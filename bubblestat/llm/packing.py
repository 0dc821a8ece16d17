"""Packing tokenised documents into fixed windows by minimum bin slack."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bpe import Encoder


def best_fill(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of lengths, each at most as often as counted, whose sum is closest to room from below: {length: times}.

    Bit s of an integer says whether the sum s can be made. Lengths come longest first, a count in halves, and the search ends
    once the room is met exactly. The integers before each step lead back to the counts.
    """
    mask, sums, steps = (1 << room + 1) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], room // length) if length <= room else 0, 1
        while left:
            part = min(part, left)
            steps.append((sums, length, part))
            sums |= sums << length * part & mask
            left, part = left - part, 2 * part
        if sums >> room & 1:
            break
    at, used = sums.bit_length() - 1, defaultdict(int)
    for before, length, part in reversed(steps):
        if not before >> at & 1:
            at -= length * part
            used[length] += part
    return dict(used)


def windows(lengths: np.ndarray, capacity: int) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) that hold every token once.

    Documents of more than a window fill whole windows first. What remains of each is a multiset of lengths: the longest opens a
    window, the best fill closes it, and the same counts serve as many windows as they can. Where slack is left, a
    remaining piece is cut to close it. The last window is cut at powers of two, which need no padding.
    """
    held: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for d, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            yield [(d, start, capacity)]
        if n % capacity:
            held[n % capacity].append((d, n - n % capacity))
    counts = {n: len(x) for n, x in held.items()}

    def take(n: int) -> tuple[int, int, int]:
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
        return (*held[n].pop(), n)

    while counts:
        first = max(counts)
        rest = {n: c - (n == first) for n, c in counts.items() if c > (n == first)}
        need = best_fill(rest, capacity - first)
        need[first] = need.get(first, 0) + 1
        slack = capacity - sum(n * c for n, c in need.items())
        for _ in range(1 if slack else min(counts[n] // c for n, c in need.items())):
            made = [take(n) for n in sorted(need, reverse=True) for _ in range(need[n])]
            if slack and counts:  # every piece left is longer than the slack
                d, start, n = take(min(counts))
                made.append((d, start, slack))
                held[n - slack].append((d, start + slack))
                counts[n - slack] = counts.get(n - slack, 0) + 1
            if sum(n for *_, n in made) == capacity:
                yield made
            else:
                yield from _at_powers(made)


def _at_powers(pieces: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    pieces = pieces[::-1]
    while pieces:
        room, made = 1 << (sum(n for *_, n in pieces).bit_length() - 1), []
        while room:
            d, start, n = pieces.pop()
            got = min(n, room)
            made.append((d, start, got))
            room -= got
            if got < n:
                pieces.append((d, start + got, n - got))
        yield made


def _pack(path: str, end_id: int, capacity: int, hold: int, kind: pa.DataType):
    names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]

    def flush(doc_ids: list, ids: list[np.ndarray], sequence: int) -> Iterator[tuple[pa.RecordBatch, int]]:
        n = np.array([len(x) for x in ids], np.int64)
        out: list[tuple] = []
        for made in windows(n, capacity):
            offset = 0
            for d, start, length in made:
                out.append((doc_ids[d], start, length, ids[d][start : start + length].tobytes(), int(n[d]), sequence, offset))
                offset += length
            sequence += 1
            if len(out) >= 4096:
                yield batch(out), sequence
                out = []
        if out:
            yield batch(out), sequence

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sequence = Encoder.of(path), TaskContext.get().partitionId() << 40
        doc_ids, held, size = [], [], 0
        for b in batches:
            at = 0
            for ids, ends in encoder.encode(b.column(1)):
                doc_ids += b.column(0).slice(at, len(ends)).to_pylist()
                at += len(ends)
                held += [np.append(x, np.uint32(end_id)).astype("<u4") for x in np.split(ids, ends[:-1])]
                size += len(ids) + len(ends)
                if size >= hold:
                    for made, sequence in flush(doc_ids, held, sequence):  # noqa: B020
                        yield made
                    doc_ids, held, size = [], [], 0
        for made, sequence in flush(doc_ids, held, sequence):  # noqa: B020
            yield made

    return run


def packed(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, hold: int = 6 << 20) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (binary, little-endian unsigned 32 bits), doc_tokens, sequence_id, offset.

    Each task packs what it reads, `hold` tokens at a time, so nothing is shuffled and memory is bounded; whole windows are the rule, and what ends a hold
    is cut at powers of two, so no sequence needs padding. sequence_id tells tasks apart by their partition number; a task that is repeated makes the same
    rows. Null texts hold the end id alone. Null and repeated doc_ids are documents of their own; doc_id keeps its type. Other columns are ignored. Empty table: no
    pieces.
    """
    rows = docs.select("doc_id", F.col("text").cast("string"))
    kind = rows.schema["doc_id"].dataType
    fields = f"doc_id {kind.simpleString()}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    return rows.mapInArrow(_pack(tokenizer, end_id, capacity, hold, to_arrow_type(kind)), fields)
