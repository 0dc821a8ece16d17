"""Line dedup: an exact set-similarity join of lines with prefix, length, positional and bitmap filters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, forget

#: 2**BITS counters tell how rare a word is: of one size for any vocabulary, so their broadcast is bounded. Sent in PARTS, summed in FAN shares.
BITS, PARTS, FAN = 21, 16, 16
#: Uses of a word for each share that its list of lines is dealt in.
SHARE = 50_000
#: Bytes of text handled at a time, and bytes whose words are hashed at a time, which fit a processor's cache.
SLICE, FINE = 8 << 20, 1 << 18
#: Postings that a task packs at a time, and pairs that it compares at a time.
PACKED, PAIRS = 1 << 19, 1 << 18
_LAST = (1 << 63) - 1
#: Hashes hardly repeat or shrink: tables of them try no dictionary and little compression.
_PLAIN = {"parquet.enable.dictionary": "false", "compression": "snappy"}
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SHIFTS = np.array([8 * (8 - size) for size in range(9)], np.uint64)
_INSIDE = bytes(b != 32 and not 9 <= b <= 13 for b in range(256))


# Words


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x * _B
    x ^= x >> np.uint64(29)
    x *= _C
    return x ^ x >> np.uint64(32)


def _lines(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all lines, the number of words of each line, and each line's text and number in it."""
    parts = [(i, *_fine(texts.slice(i, j - i))) for i, j in _slices(texts, FINE)] or [(0, *_fine(texts))]
    return tuple(np.concatenate(x) for x in ([p[1] for p in parts], [p[2] for p in parts], [p[0] + p[3] for p in parts], [p[4] for p in parts]))


def _words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, bytes, np.ndarray]:
    """Word hashes of a few texts, where the words begin, the bytes of all texts, and where each text begins or ends.

    Words are hashed eight bytes at a time, in all texts at once; a word of up to eight bytes has a hash of its own among those of its length."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]].tobytes()
    ends = ends - ends[0]
    inside = np.frombuffer(raw.translate(_INSIDE), bool)
    edge = np.unique(ends[(ends > 0) & (ends < len(raw))])  # a word ends where its text does
    first, last = inside.copy(), inside.copy()
    np.greater(inside[1:], inside[:-1], out=first[1:])
    np.greater(inside[:-1], inside[1:], out=last[:-1])
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    first, size = np.flatnonzero(first), np.flatnonzero(last)
    size = size - first + 1
    eight = np.ndarray(len(raw) + 1, "<u8", raw.translate(_LOWER) + bytes(8), strides=(1,))
    h = _mixed(size.astype(np.uint64) * _A ^ eight[first] << _SHIFTS[np.minimum(size, 8)])
    live, done = np.flatnonzero(size > 8), 8
    while len(live):
        rest = size[live] - done
        h[live] = _mixed(h[live] ^ eight[first[live] + done] << _SHIFTS[np.minimum(rest, 8)])
        live, done = live[rest > 8], done + 8
    return h, first, raw, ends


def _fine(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What _lines() gives, of a few texts."""
    h, first, raw, ends = _words(texts)
    breaks = np.flatnonzero(np.frombuffer(raw, np.uint8) == 10)
    per_text = np.diff(np.searchsorted(breaks, ends)) + 1
    head = np.cumsum(per_text) - per_text
    begins = np.empty(int(per_text.sum()), np.int64)
    is_head = np.zeros(len(begins), bool)
    is_head[head] = True
    begins[is_head], begins[~is_head] = ends[:-1], breaks + 1
    counts = np.diff(np.append(np.searchsorted(first, begins), len(first)))
    owner = np.repeat(np.arange(len(texts)), per_text)
    return h, counts, owner, np.arange(len(begins)) - head[owner]


def _slices(texts: pa.Array, most: int | None = None) -> Iterator[tuple[int, int]]:
    """Runs of texts of about SLICE bytes, or as many as told."""
    most = most or SLICE
    size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    cuts = np.unique(np.append(np.searchsorted(size, np.arange(most, size[-1] if len(size) else 0, most)) + 1, len(texts)))
    yield from ((a, b) for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True) if b > a)


def _distinct(key: np.ndarray, line: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, line) in the order of line and key, without repeats; line comes in order. Packed into one number for the sort where that tells all keys of a line apart."""
    short = line.astype(np.uint64) << np.uint64(44) | key >> np.uint64(20)
    order = np.argsort(short)
    same = np.diff(short[order]) == 0
    if len(line) and line[-1] >= 1 << 20 or (np.diff(key[order])[same] != 0).any():
        order = np.lexsort((key, line))
    key, line = key[order], line[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1])
    return key[fresh], line[fresh]


# How rare words are


def _packed(total: np.ndarray) -> pa.RecordBatch:
    parts = [zstandard.ZstdCompressor(level=1).compress(p.tobytes()) for p in np.split(total, PARTS)]
    return pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([TaskContext.get().partitionId() % FAN] * PARTS, pa.int32()), pa.array(parts, pa.binary())], ["part", "fan", "counts"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << BITS, np.int64)
    for b in batches:
        for i, j in _slices(b.column(0), FINE):
            np.add.at(total, (_words(b.column(0).slice(i, j - i))[0] >> np.uint64(64 - BITS)).astype(np.int64), 1)
    if total.any():
        yield _packed(total)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums counters of a part as they stream in: memory is that of the parts, however many tasks sent them."""
    totals: dict[int, np.ndarray] = {}
    for b in batches:
        for part, counts in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
            new = np.frombuffer(zstandard.ZstdDecompressor().decompress(counts), np.int64)
            totals[part] = totals[part] + new if part in totals else new
    for part, total in totals.items():
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([0], pa.int32()), pa.array([zstandard.ZstdCompressor(level=1).compress(total.tobytes())], pa.binary())], ["part", "fan", "counts"])


def _counters(rows: DataFrame, count) -> np.ndarray:
    """The sum of what all tasks count: 2**BITS numbers."""
    fields = "part int, fan int, counts binary"
    sent = rows.mapInArrow(count, fields).repartition(PARTS, "part", "fan").mapInArrow(_add, fields)
    out = np.zeros((PARTS, (1 << BITS) // PARTS), np.int64)
    for r in sent.repartition(PARTS, "part").mapInArrow(_add, fields).collect():  # PARTS rows of fixed size
        out[r["part"]] = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["counts"]), np.int64)
    return out.ravel()


def rarity(docs: DataFrame) -> np.ndarray:
    """For each of 2**BITS classes of words a byte that grows with how often they occur in all texts; 0: once at most.

    Each task sends its counters in PARTS; they are summed in two rounds, first in FAN shares."""
    total = _counters(docs.select("text"), _count)
    return np.where(total < 2, 0, np.minimum(255, 1 + 7 * np.log2(np.maximum(total, 1)))).astype(np.uint8)


def _fewest(similarity: float) -> int:
    """The fewest words at which two different sets can be as similar: below, only equal sets match."""
    return next((n for n in range(1, 1000) if n >= similarity * (n + 1) - 1e-9), 1000)


# Lines


def _describe(shared, similarity: float):
    """Rows (id, doc, hash, line, n, a, b, bits, more, skip, words) from texts in order; id follows that order.

    n: different words; a, b: hash of their set; bits, more: a bitmap of them; words: the rarest of them, from the one at place `skip` on, by which similar
    lines meet. A line equal to an earlier one of the slice needs none of these and has n = 0; blank lines have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rank, at, seen = shared.value, TaskContext.get().partitionId() << 40, None
        for batch in batches:
            for i, j in _slices(batch.column(2)):
                doc, text_hash = (batch.column(k).slice(i, j - i).to_numpy(zero_copy_only=False) for k in (0, 1))
                new = np.ones(j - i, bool)  # rows that repeat a document as a whole follow it
                new[1:] = (doc[1:] != doc[:-1]) | (text_hash[1:] != text_hash[:-1])
                new[0] = (doc[0], text_hash[0]) != seen
                seen = (doc[-1], text_hash[-1])
                texts = batch.column(2).slice(i, j - i)
                yield from described(rank, texts.filter(pa.array(new)), doc[new], text_hash[new], at)
                at += int(pc.sum(pc.binary_length(texts)).as_py() or 0) + j - i  # as many lines at most

    def sets(rank, texts, before, lines_before):
        """Of a few texts: distinct words of lines in order of rarity, and of each line with words its place, text, number, size, hash and bitmap; and how many lines there are."""
        h, counts, owner, number = _fine(texts)
        key = (rank[h >> np.uint64(64 - BITS)].astype(np.uint64) << np.uint64(56)) | (h & np.uint64((1 << 56) - 1))
        key, line = _distinct(key, np.repeat(np.arange(len(counts)), counts))
        begins = np.flatnonzero(np.append(True, line[1:] != line[:-1])[: len(line)])
        use, n = line[begins], np.diff(begins, append=len(line))
        if not len(use):
            return [key, use, use, use, n, key, key, key, key], len(counts)
        a = np.add.reduceat(_mixed(key + _A), begins)
        b = np.add.reduceat(_mixed(key ^ _C), begins)
        bit, low = np.uint64(1) << (key & np.uint64(63)), key & np.uint64(64) == 0
        bits, more = (np.bitwise_or.reduceat(np.where(half, bit, np.uint64(0)), begins) for half in (low, ~low))
        return [key, use + lines_before, owner[use] + before, number[use], n, a, b, bits, more], len(counts)

    def described(rank, texts, doc, text_hash, at):
        parts, total = [], 0
        for i, j in _slices(texts, FINE):
            part, size = sets(rank, texts.slice(i, j - i), i, total)
            parts.append(part)
            total += size
        if not any(len(p[1]) for p in parts):
            return
        key, use, owner, number, n, a, b, bits, more = map(np.concatenate, zip(*parts, strict=True))
        begins = np.cumsum(n) - n
        ahead = np.where(n < _fewest(similarity), 0, n - np.ceil(similarity * n - 1e-9).astype(np.int64) + 1)
        order = np.lexsort((b, a))  # stable: of equal sets, the first stays
        again = np.zeros(len(n), bool)
        again[order[1:]] = (a[order[1:]] == a[order[:-1]]) & (b[order[1:]] == b[order[:-1]])
        place = np.arange(len(key)) - np.repeat(begins, n)
        kept = (place < np.repeat(np.where(again, 0, ahead), n)) & (key >> np.uint64(56) > 0)  # a word that occurs once matches nothing
        sizes = np.add.reduceat(kept.astype(np.int64), begins)
        skip = np.minimum.reduceat(np.where(kept, place, n.max()), begins)  # kept words of a line are next to each other
        ids = at + use
        a, b = np.where(again, ids.view(np.uint64), a), np.where(again, np.uint64(0), b)
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(key[kept].view(np.int64)))
        whole = [pa.array(x.view(np.int64)) for x in (a, b, bits, more)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids), pa.array(doc[owner]), pa.array(text_hash[owner]), pa.array(number.astype(np.int32)), pa.array(np.where(again, 0, n).astype(np.int32)), *whole, pa.array(skip.astype(np.int32)), lists],
            ["id", "doc", "hash", "line", "n", "a", "b", "bits", "more", "skip", "words"],
        )

    return run


# Candidates


def _shares(word: np.ndarray, share: int) -> np.ndarray:
    """How many shares a word's list is dealt in: as many as its rarity byte tells that its uses fill."""
    return np.ceil(np.exp2(((word >> np.uint64(56)).astype(float) - 1) / 7) / share).astype(np.int64)


def _wide(words: Column, share: int) -> Column:
    """Whether the list of any of a line's words has more than one share. The last is the most frequent."""
    uses = F.pow(F.lit(2.0), (F.shiftrightunsigned(F.element_at(words, -1), 56) - 1) / 7)
    return F.coalesce(uses > share, F.lit(False))


_POST = [("key", "<u4"), ("id", "<i8"), ("n", "<u4"), ("place", "<u4"), ("bits", "<u8"), ("more", "<u8"), ("asks", "u1")]
_POST_BYTES = np.dtype(_POST).itemsize


def _posts(cells: int, share: int, wanted=None):
    """Postings of lines (id, n, bits, more, skip, words, asks), packed by cell of the word and its share: (cell, posts).

    Without `wanted` each line is in its own share of each list, and asks there. With it, lists of words that it flags are made: lines are in
    their own share, and those that ask do so in all shares."""

    def made(batch: pa.RecordBatch) -> list[np.ndarray]:
        lists = batch.column(5)
        sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
        of = np.repeat(np.arange(len(sizes)), sizes)
        word = lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        ids, n, bits, more, skip, asks = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1, 2, 3, 4, 6))
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + skip[of]
        if wanted is not None:
            use = wanted.value[_flag(word)]
            of, word, place = of[use], word[use], place[use]
        shares = _shares(word, share)
        own = (_mixed(ids[of].astype(np.uint64) + _A) >> np.uint64(8)).astype(np.int64) % shares
        kinds = [(of, word, place, own, wanted is None)]
        if wanted is not None:
            times = np.where(asks[of], shares, 0)
            each = np.repeat(np.arange(len(of)), times)
            kinds.append((of[each], word[each], place[each], np.arange(len(each)) - np.repeat(np.cumsum(times) - times, times), True))
        out = []
        for f, w, p, s, ask in kinds:
            mixed = _mixed((w & np.uint64((1 << 56) - 1)) + s.astype(np.uint64) * _A)
            columns = (mixed & np.uint64(0xFFFFFFFF), ids[f], n[f], p, bits[f].view(np.uint64), more[f].view(np.uint64), np.full(len(f), ask))
            out.append([((mixed >> np.uint64(32)) % np.uint64(cells)).astype(np.uint32), *(c.astype(kind, copy=False) for c, (_, kind) in zip(columns, _POST, strict=True))])
        return list(map(np.concatenate, zip(*out, strict=True)))

    def flush(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        pack = zstandard.ZstdCompressor(level=1).compress
        cell, *columns = map(np.concatenate, zip(*held, strict=True))
        order = np.argsort(cell.astype(np.uint16) if cells <= 1 << 16 else cell, kind="stable")
        cell, columns = cell[order], [c[order] for c in columns]
        begins = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        ids = columns[1]
        columns[1] = np.diff(ids, prepend=0)
        columns[1][begins] = ids[begins]
        rows = [pack(b"".join(c[i:j].tobytes() for c in columns)) for i, j in zip(begins.tolist(), [*begins[1:].tolist(), len(cell)], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(cell[begins].astype(np.int32)), pa.array(rows, pa.binary())], ["cell", "posts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(made(b))
            size += len(held[-1][0])
            if size >= PACKED:
                yield flush(held)
                held, size = [], 0
        if size:
            yield flush(held)

    return run


def _flag(word: np.ndarray) -> np.ndarray:
    return (_mixed(word & np.uint64((1 << 56) - 1)) >> np.uint64(64 - BITS)).astype(np.int64)


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters of the words that lines (words) ask for."""
    total = np.zeros(1 << BITS, np.int64)
    for b in batches:
        total[_flag(b.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))] = 1
    if total.any():
        yield _packed(total)


def _candidates(similarity: float, every: bool):
    """(x, y, distance, more): for lines x that ask, earlier lines y of a list that can be as similar, by sizes, places and bitmaps.

    A list is searched in growing steps. Unless `every`, a line's search ends with the step in which it meets a candidate, the nearest of which is
    given; `more` tells that there may be others."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> list[np.ndarray]:
        out = [[np.zeros(0, kind) for kind in ("<u4", *(kind for _, kind in _POST))]]
        for b in batches:
            for cell, posts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(posts)
                size, at = len(raw) // _POST_BYTES, 0
                columns = [np.full(size, cell, np.uint32)]
                for c, kind in _POST:
                    part = np.frombuffer(raw, kind, size, at)
                    columns.append(np.cumsum(part) if c == "id" else part)
                    at += part.nbytes
                out.append(columns)
        return list(map(np.concatenate, zip(*out, strict=True)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, key, ids, n, place, bits, rest, asks = unpacked(batches)
        group = cell.astype(np.uint64) << np.uint64(32) | key
        if len(cell) and cell.min() == cell.max():
            order = np.argsort(key.astype(np.uint64) << np.uint64(32) | n)
        else:
            order = np.lexsort((n, group))
        group, ids, n, place, bits, rest, asks = (x[order] for x in (group, ids, n.astype(np.int64), place.astype(np.int64), bits, rest, asks))
        number = np.cumsum(np.append(0, group[1:] != group[:-1])) << 32 if len(ids) else np.zeros(0, np.int64)
        at = np.searchsorted(number + n, number + np.ceil(similarity * n - 1e-9).astype(np.int64))
        end = np.searchsorted(number + n, number + np.floor(n / similarity + 1e-9).astype(np.int64), side="right")
        short = n - np.ceil(2 * similarity / (1 + similarity) * n - 1e-9).astype(np.int64) + 1  # as few words suffice for the smaller of two
        fits, left, n = place < short, (n - place).astype(np.int32), n.astype(np.int32)
        live, width = np.flatnonzero((end - at > 1) & (asks > 0)), 8
        while len(live):
            steps = np.minimum(width, end[live] - at[live])
            found = np.zeros(len(live), bool)
            parts = np.unique(np.append(np.searchsorted(np.cumsum(steps), np.arange(PAIRS, steps.sum(), PAIRS)) + 1, len(live)))
            for i, j in zip([0, *parts[:-1].tolist()], parts.tolist(), strict=True):
                own, step = live[i:j], steps[i:j]
                x = np.repeat(own, step)
                y = np.repeat(at[own] - (np.cumsum(step) - step), step) + np.arange(len(x))
                ok = ids[y] < ids[x]
                x, y = x[ok], y[ok]
                x_fewer = n[x] < n[y]
                ok = fits[x] & x_fewer | fits[y] & ~x_fewer
                x, y = x[ok], y[ok]
                both = n[x] + n[y]
                need = np.ceil(similarity / (1 + similarity) * both - 1e-9).astype(np.int32)
                ok = np.minimum(left[x], left[y]) >= need
                x, y, most = x[ok], y[ok], (both - 2 * need)[ok]
                far = np.bitwise_count(bits[x] ^ bits[y]).astype(np.int64) + np.bitwise_count(rest[x] ^ rest[y])
                ok = far <= most
                x, y, far = x[ok], y[ok], far[ok]
                if not len(x):
                    continue
                if every:
                    yield rows(ids[x], ids[y], far, np.zeros(len(x), bool))
                    continue
                order = np.lexsort((far, x))
                x, y, far = x[order], y[order], far[order]
                best, times = np.unique(x, return_index=True, return_counts=True)[1:]
                met = x[best]
                found[i + np.searchsorted(own, met)] = True
                yield rows(ids[met], ids[y[best]], far[best], (times > 1) | (at[met] + width < end[met]))
            at[live] += steps
            live, width = live[~found & (at[live] < end[live])], min(4 * width, 1 << 14)

    def rows(x, y, far, more):
        return pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(far), pa.array(more)], ["x", "y", "distance", "more"])

    return run


def _met(lines: DataFrame, similarity: float, share: int, wanted=None) -> DataFrame:
    """Distinct candidates (x, y, distance, more) of lines; more holds for the pair's x."""
    cells = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    posts = lines.mapInArrow(_posts(cells, share, wanted), "cell int, posts binary").repartitionById(cells, F.col("cell"))
    found = posts.mapInArrow(_candidates(similarity, wanted is not None), "x long, y long, distance long, more boolean")
    return cut(found.groupBy("x", "y").agg(F.min("distance").alias("distance"), F.max("more").alias("more")), "lines")


# Comparison


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, w) of asked lines (doc, hash, text, asked): the different words of each. Rows that repeat a document as a whole are skipped."""
    seen = set()
    for b in batches:
        keys = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        new = [k not in seen and not seen.add(k) for k in keys]
        b = b.filter(pa.array(new, pa.bool_()))
        texts = b.column(2)
        for i, j in _slices(texts):
            ids, found = [], []
            for text, asked in zip(texts.slice(i, j - i).to_pylist(), b.column(3).slice(i, j - i).to_pylist(), strict=True):
                parts = text.split("\n")
                ids += [a["id"] for a in asked]
                found += [parts[a["line"]] for a in asked]
            h, counts, *_ = _lines(pa.array(found, pa.string()))
            h, line = _distinct(h, np.repeat(np.arange(len(counts)), counts))
            ends = np.append(0, np.cumsum(np.bincount(line, minlength=len(ids)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["id", "w"])


def _verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame, similarity: float, few: bool) -> DataFrame:
    """Lines (`id`) x of the pairs (x, y, distance) whose Jaccard similarity, over the lines' words, is high enough.

    One match settles a line. So, unless they are few, each is compared with its nearest candidate first, and with all of them only if that fails."""
    asked = pairs.select(F.col("x").alias("id")).union(pairs.select("y")).distinct()
    places = lines.select("id", "doc", "hash", "line").join(asked, "id").groupBy("doc", "hash").agg(F.collect_list(F.struct("line", "id")).alias("asked"))
    found = docs.join(places.hint("shuffle_hash"), ["doc", "hash"]).select("doc", "hash", "text", "asked").mapInArrow(_hashed, "id long, w array<long>")
    words = cut(found, "lines", **_PLAIN)

    def matched(some: DataFrame) -> DataFrame:
        joined = some.join(words.select(F.col("id").alias("x"), F.col("w").alias("xw")), "x").join(words.select(F.col("id").alias("y"), F.col("w").alias("yw")), "y")
        common = F.size(F.array_intersect("xw", "yw"))
        return cut(joined.where(common >= similarity * (F.size("xw") + F.size("yw") - common) - 1e-9).select(F.col("x").alias("id")).distinct(), "lines")

    if few:
        found = matched(pairs.select("x", "y"))
        forget(words)
        return found
    near = matched(pairs.groupBy("x").agg(F.min(F.struct("distance", "y")).alias("b")).select("x", "b.y"))
    rest = matched(pairs.join(near.withColumnRenamed("id", "x"), "x", "left_anti").select("x", "y"))
    forget(words)
    return near.union(rest)


def later_matches(docs: DataFrame, similarity: float = 0.8, share: int = SHARE) -> DataFrame:
    """(doc, hash, removed): line numbers that go, for each document that has any. doc and hash are the keys of keyed()."""
    spark, order = docs.sparkSession, ["doc", "hash"]
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shared = spark.sparkContext.broadcast(rarity(docs))
    fields = "id long, doc long, hash long, line int, n int, a long, b long, bits long, more long, skip int, words array<long>"
    texts = docs.select(*order, "text").repartitionByRange(spread, *order).sortWithinPartitions(*order)
    # Equal sets of words: all but the first line of each go, whatever else happens.
    first = (F.col("n") > 0) & (F.min("id").over(W.partitionBy("a", "b")) == F.col("id"))
    lines = cut(texts.mapInArrow(_describe(shared, similarity), fields).withColumn("first", first).drop("a", "b"), "lines", **_PLAIN)
    firsts = lines.where("first and size(words) > 0")
    posts = firsts.select("id", "n", "bits", "more", "skip", "words")
    pairs = _met(posts.withColumn("asks", F.lit(True)), similarity, share)
    gone = _verified(pairs, lines, docs, similarity, True)  # at most a candidate for each word
    # Lines that may have other candidates, against all lines before them.
    more = pairs.where("more").select(F.col("x").alias("id")).union(firsts.where(_wide(F.col("words"), share)).select("id"))
    left = cut(more.distinct().join(gone, "id", "left_anti"), "lines")
    forget(pairs)
    marked = posts.join(left.withColumn("asks", F.lit(True)), "id", "left").withColumn("asks", F.coalesce("asks", F.lit(False)))
    flags = _counters(marked.where("asks").select("words"), _asked) > 0
    pairs = _met(marked, similarity, share, spark.sparkContext.broadcast(flags))
    gone = gone.union(_verified(pairs, lines, docs, similarity, False)).distinct().withColumn("gone", F.lit(True))
    out = lines.select("id", *order, "line", "first").join(gone, "id", "left").where("not first or gone")
    out = cut(out.groupBy(*order).agg(F.collect_list("line").alias("removed")), "lines")
    for used in (pairs, left, lines):
        forget(used)
    return out


def keyed(docs: DataFrame) -> DataFrame:
    """text, and what places a line in the order of all lines: doc_id (null: last), then a hash of the text, then the line's number."""
    return docs.select(*_key(), "text")


def _key() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64("text").alias("hash")]


def with_removed(docs: DataFrame, similarity: float = 0.8, share: int = SHARE) -> DataFrame:
    """(row, text, removed): each row of docs as a struct, its text without later lines that match an earlier one, and their numbers (from 0; null: none)."""
    removed = later_matches(keyed(docs), similarity, share)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *_key())
    joined = rows.join(removed.hint("shuffle_hash"), ["doc", "hash"], "left")
    text = F.array_join(F.filter(F.split("row.text", "\n"), lambda t, i: ~F.array_contains("removed", i)), "\n")
    return joined.select("row", F.when(F.col("removed").isNull(), F.col("row.text")).otherwise(text).alias("text"), "removed")


def deduplicated(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """docs without later lines that match an earlier one.

    Lines are parts between \\n; two match if the Jaccard similarity of their sets of words (A-Z lower-cased) is `similarity` or
    more. A line goes if any earlier line matches it, whether that stays or not; earlier is by doc_id (null last), hash of the text, number.
    Lines without words stay. Rows that repeat a document as a whole count as that document and lose the same
    lines. Null texts have no lines and stay null; a text may become empty; texts of any length are taken whole. Other columns pass through,
    whatever their names; n_chars, if there, is counted anew.

    Words are ordered by rarity over all texts. A line's rarest n - ceil(s n) + 1 words are posted, of which the smaller of two similar lines needs
    fewer, and candidates must pass filters on size, place and a bitmap before their words are compared. Lines of so few words that only equal
    sets are similar enough (below 4 at 0.8) are settled by the set's hash. Words are told apart by 64-bit hashes, sets by 128 bits.
    """
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return with_removed(docs, similarity).select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
