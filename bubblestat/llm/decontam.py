"""Benchmark decontamination by winnowed fingerprints."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from .common import cut

#: Bytes to what a word may hold: A-Z become a-z, other ASCII but 0-9 and a-z a space, bytes of other letters stay.
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Bits of the table that is asked before the exact set of fingerprints.
_BITS = 20
#: Bits of the number of flags that tell which fingerprints a large benchmark may have.
FLAGS = 24
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD).split()


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k words in a row, from the hashes of single words."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * _ODD + h[i : i + n]
    out ^= out >> np.uint64(31)
    return out * _ODD


def _chosen(g: np.ndarray, window: int) -> np.ndarray:
    """Places whose hash is the least of some `window` in a row: each such window keeps one or more."""
    if len(g) <= window:
        return np.flatnonzero(g == g.min()) if len(g) else np.zeros(0, np.int64)
    n = len(g) - window + 1
    least = g[:n]
    for i in range(1, window):
        least = np.minimum(least, g[i : i + n])
    keep = np.zeros(len(g), bool)
    for i in range(window):
        keep[i : i + n] |= least == g[i : i + n]
    return np.flatnonzero(keep)


def prints_of(words: list[bytes], span: int, k: int) -> Iterator[tuple[int, int, int]]:
    """(size, hash, place) of an item's fingerprints: size 0 for those of k words that winnowing keeps, else that of a short item, which is one gram."""
    h = np.array([xxh3_64_intdigest(x) for x in words], np.uint64)
    short = len(words) < span
    g = _grams(h, len(words) if short else k)
    for p in [0] if short else _chosen(g, span - k + 1).tolist():
        yield len(words) if short else 0, int(g[p]), p


class Block:
    """Fingerprints of a bounded number of item segments, and their words to extend hits by."""

    def __init__(self, items: list[tuple[str, bytes]], span: int, k: int):
        self.span, self.k, self.window = span, k, span - k + 1
        self.items = [(i, seg.split()) for i, seg in items]
        self.prints: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for n, (_, w) in enumerate(self.items):
            for size, g, p in prints_of(w, span, k):
                self.prints[size][g].append((n, p))
        self.prints = {size: dict(x) for size, x in self.prints.items()}
        self.maybe = {}
        for size, x in self.prints.items():
            self.maybe[size] = np.zeros(1 << _BITS, bool)
            self.maybe[size][np.fromiter(x, np.uint64, len(x)) >> np.uint64(64 - _BITS)] = True

    def hits(self, docs: list[list[bytes]]) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """For each document with an occurring window: its hit spans (start, end), merged, and the items."""
        ends = np.cumsum([len(w) for w in docs])
        h = np.fromiter((xxh3_64_intdigest(x) for w in docs for x in w), np.uint64, int(ends[-1]) if len(docs) else 0)
        found: dict[int, list] = defaultdict(list)
        for size, prints in self.prints.items():
            g = _grams(h, size or self.k)
            at = np.flatnonzero(self.maybe[size][g >> np.uint64(64 - _BITS)])
            if not size and len(at):  # windows across two documents only add places
                at = at[np.isin(at, _chosen(g, self.window), assume_unique=True)]
            owner = np.searchsorted(ends, at, side="right")
            for p, d in zip(at.tolist(), owner.tolist(), strict=True):
                for item in prints.get(int(g[p]), ()):
                    found[d].append((p - int(ends[d]) + len(docs[d]), *item))
        out = {}
        for d, seeds in found.items():
            spans, items = self.confirmed(docs[d], seeds)
            if spans:
                out[d] = (merged(spans), items)
        return out

    def confirmed(self, doc: list[bytes], seeds: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], set[str]]:
        """Spans and items of seeds (place in the document, segment, place in it) whose equal runs hold a window."""
        spans, items, done = [], set(), defaultdict(int)
        for p, n, q in sorted(seeds, key=lambda s: (s[1], s[0] - s[2], s[0])):
            if p < done[n, p - q]:
                continue  # within a span that was extended already
            a, b = self._extended(doc, p, self.items[n][1], q)
            done[n, p - q] = max(b, p + 1)
            if b - a >= min(self.span, len(self.items[n][1])):
                spans.append((a, b))
                items.add(self.items[n][0])
        return spans, items

    @staticmethod
    def _extended(doc: list[bytes], p: int, item: list[bytes], q: int) -> tuple[int, int]:
        a = b = p
        while a > 0 and a - p + q > 0 and doc[a - 1] == item[a - 1 - p + q]:
            a -= 1
        while b < len(doc) and b - p + q < len(item) and doc[b] == item[b - p + q]:
            b += 1
        return (a, b) if b > p else (p, p)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def segments(benchmark: DataFrame, span: int, words: int = 2048) -> DataFrame:
    """(item, seg) of the benchmark: items in runs of `words` words that overlap by span - 1, so that each window lies in one. A null item_id is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for i, t in zip(b["item"], b["text"], strict=True):
                w = words_of(t)
                rows += [(i, b" ".join(w[a : a + words + span - 1])) for a in range(0, max(len(w) - span + 1, 1), words) if w]
            yield pd.DataFrame(rows, columns=["item", "seg"])

    named = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").distinct()
    return named.mapInPandas(run, "item string, seg binary").distinct()


def _slices(texts: list, chars: int = 1 << 20) -> Iterator[list]:
    """Runs of texts of about so many characters, so that memory doesn't follow the batch."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "") + 64
        if size >= chars:
            yield held
            held, size = [], 0
    if held:
        yield held


_HITS = "n_words int, starts array<int>, ends array<int>, items array<string>"


def _row(n_words: int, spans: list[tuple[int, int]], items: set[str]) -> tuple:
    return n_words, [a for a, _ in spans], [b for _, b in spans], sorted(items)


def _hits_udf(shared):
    @F.pandas_udf(_HITS)
    def run(text: pd.Series) -> pd.DataFrame:
        out = []
        for texts in _slices(text.tolist()):
            docs = [words_of(t) for t in texts]
            got = shared.value.hits(docs)
            out += [_row(len(w), *got.get(d, ([], set()))) for d, w in enumerate(docs)]
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    return run


def _seen(segs: DataFrame, span: int, k: int) -> tuple[np.ndarray, list[int]]:
    """2**FLAGS flags of the benchmark's fingerprints, of one size for any benchmark, and the sizes of its short items."""

    def flags(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found, sizes = np.zeros(1 << FLAGS, bool), set()
        for b in batches:
            for seg in b["seg"]:
                for size, g, _ in prints_of(seg.split(), span, k):
                    found[g >> 64 - FLAGS] = True
                    sizes.add(size)
        if sizes:
            yield pd.DataFrame({"part": range(16), "flags": [zlib.compress(x.tobytes(), 1) for x in np.split(np.packbits(found), 16)], "sizes": [sorted(sizes)] * 16})

    def either(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts, sizes = {}, set()
        for b in batches:
            for p, x, s in zip(b["part"], b["flags"], b["sizes"], strict=True):
                new = np.frombuffer(zlib.decompress(x), np.uint8)
                parts[p] = parts[p] | new if p in parts else new
                sizes |= set(s)
        if parts:
            yield pd.DataFrame({"part": list(parts), "flags": [zlib.compress(x.tobytes(), 1) for x in parts.values()], "sizes": [sorted(sizes)] * len(parts)})

    fields = "part int, flags binary, sizes array<int>"
    rows = sorted(segs.mapInPandas(flags, fields).repartition(16, "part").mapInPandas(either, fields).collect())  # 16 rows of fixed size
    bits = np.concatenate([np.frombuffer(zlib.decompress(r["flags"]), np.uint8) for r in rows]) if rows else np.zeros((1 << FLAGS) // 8, np.uint8)
    return np.unpackbits(bits).astype(bool), sorted({s for r in rows for s in r["sizes"]})


def _joined_hits(docs: DataFrame, segs: DataFrame, span: int, k: int) -> DataFrame:
    """(a, b, hits) of distinct texts with hits, by two hashes of the text: fingerprints of both sides meet in a join, then texts and segments that share any."""
    spark, key = docs.sparkSession, ["a", "b"]
    segs = cut(segs.select("item", "seg", F.xxhash64("item", "seg").alias("s")), "decontam")
    flags, sizes = _seen(segs, span, k)
    shared = spark.sparkContext.broadcast((flags, sizes))

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(s, *x) for s, seg in zip(b["s"], b["seg"], strict=True) for x in prints_of(seg.split(), span, k)]
            found = pd.DataFrame(rows, columns=["s", "size", "g", "q"])
            yield found.assign(g=found["g"].astype("uint64").to_numpy().view(np.int64))

    def probes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        maybe, sizes = shared.value
        for batch in batches:
            for i in range(0, len(batch), 256):
                part, out = batch[i : i + 256], []
                for a, b, t in zip(part["a"], part["b"], part["text"], strict=True):
                    h = np.fromiter(map(xxh3_64_intdigest, words_of(t)), np.uint64)
                    for size in sizes:
                        g = _grams(h, size or k)
                        at = np.flatnonzero(maybe[g >> np.uint64(64 - FLAGS)])
                        at = at if size else np.intersect1d(at, _chosen(g, span - k + 1))
                        out += [(a, b, size, x, p) for x, p in zip(g[at].view(np.int64).tolist(), at.tolist(), strict=True)]
                yield pd.DataFrame(out, columns=["a", "b", "size", "g", "p"])

    def confirm(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for a, b, t, item, seg, seeds in zip(*(batch[c] for c in ("a", "b", "text", "item", "seg", "seeds")), strict=True):
                spans, items = Block([(item, seg)], span, k).confirmed(words_of(t), [(x["p"], 0, x["q"]) for x in seeds])
                if spans:
                    out.append((a, b, item, [x for x, _ in spans], [x for _, x in spans]))
            yield pd.DataFrame(out, columns=["a", "b", "item", "starts", "ends"])

    prints = segs.mapInPandas(listed, "s long, size int, g long, q int")
    seeds = docs.mapInPandas(probes, "a long, b long, size int, g long, p int").distinct().join(prints, ["size", "g"])
    seeds = cut(seeds.groupBy(*key, "s").agg(F.collect_list(F.struct("p", "q")).alias("seeds")), "decontam")
    both = docs.dropDuplicates(key).join(seeds, key).join(segs, "s")
    spans = both.select(*key, "text", "item", "seg", "seeds").mapInPandas(confirm, "a long, b long, item string, starts array<int>, ends array<int>")
    pairs = F.flatten(F.collect_list(F.arrays_zip("starts", "ends")))
    return spans.groupBy(*key).agg(F.array_sort(F.collect_set("item")).alias("items"), F.array_sort(pairs).alias("spans"))


def with_hits(docs: DataFrame, benchmark: DataFrame, span: int = 13, k: int = 7, block_bytes: int = 16 << 20) -> DataFrame:
    """(row, hits): each row of docs as a struct, and n_words, starts and ends of merged hit spans (in words), items (their sorted item_ids).

    A window is `span` consecutive words of an item, or a shorter item as a whole. Fingerprints are the least hash of k words in each
    span - k + 1 in a row, so any shared window shares one at the same place in it; each shared one is extended to the longest
    equal run of words, and runs that hold a window are hits. A benchmark of up to block_bytes is sent to all tasks, and documents
    never shuffle. Beyond that, fingerprints of documents and items are joined, documents' after a look at 2**FLAGS flags; only texts that share
    one are then joined with the item's segments. Texts are read whole, whatever their length; long items in segments.

    Null texts have no words. An item without words has no window; a null item_id is listed as an empty string. Repeated
    documents and items are each judged. Empty tables: no documents, or no hits. Columns may have any names.
    """
    spark, text = docs.sparkSession, F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text.alias("text"))
    segs = segments(benchmark, span)
    if (segs.agg(F.sum(F.octet_length("seg") + 64)).first()[0] or 0) <= block_bytes:
        block = Block([tuple(r) for r in segs.collect()], span, k)  # of block_bytes at most
        return rows.select("row", _hits_udf(spark.sparkContext.broadcast(block))("text").alias("hits"))
    keys = F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), "text").alias("b")
    found = _joined_hits(rows.select("text", *keys), segs, span, k)

    @F.pandas_udf(_HITS)
    def whole(text: pd.Series, items: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = [_row(len(words_of(t)), [] if s is None else merged([(x["starts"], x["ends"]) for x in s]), set() if i is None else set(i)) for t, i, s in zip(text, items, spans, strict=True)]
        return pd.DataFrame(out, columns=["n_words", "starts", "ends", "items"])

    joined = rows.select("row", "text", *keys).join(found, ["a", "b"], "left")
    return joined.select("row", whole("text", "items", "spans").alias("hits"))


def n_hit(hits: str = "hits"):
    """Words inside hit spans."""
    sums = [F.aggregate(f"{hits}.{side}", F.lit(0).cast("long"), lambda a, x: a + x) for side in ("ends", "starts")]
    return sums[0] - sums[1]


def contaminated(hits: str = "hits"):
    """At least one word hit, and at least one in twenty."""
    return (n_hit(hits) > 0) & (20 * n_hit(hits) >= F.col(f"{hits}.n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    return with_hits(docs, benchmark, **how).where(~contaminated()).select("row.*")
