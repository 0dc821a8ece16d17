"""SimHash near-duplicates by anchor-point covering."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, width
from .components import components

#: Hashes unpacked to bits at a time, so that a very long text needs no more memory than a short one.
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit SimHash, as a signed integer; words are runs of non-space bytes, A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = zip(*(words[i:] for i in range(shingle)), strict=False) if len(words) >= shingle else [words]
    h = np.array([xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(h), BLOCK):
        ones += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


@F.pandas_udf(LongType())
def fingerprint_udf(text: pd.Series) -> pd.Series:
    return text.map(fingerprint)


def anchors(fp: Column) -> Column:
    """All codewords of the [63, 57] Hamming code within 2 bits of the lower 63 bits of fp.

    The code's covering radius is 1. Where two fingerprints differ in at most two bits, some point lies within one
    bit of both; its anchor, within radius 1 of that point, is within radius 1 + 1 of both. The threshold
    is thus met from both sides and each side needs the radius plus half the threshold only: 32 anchors, not 652.

    The syndrome s is the XOR of the (1-based) places of the set bits. Flips that lead to a codeword have XOR s:
    none if s is 0, else the place s, or one of the 31 pairs i, i XOR s.
    """
    s = F.lit(0)
    for k in range(6):
        places = sum(1 << (i - 1) for i in range(1, 64) if i >> k & 1)
        s = s + (F.bit_count(fp.bitwiseAND(F.lit(places))) % 2) * (1 << k)
    bit = lambda i: F.when(i == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), i - 1))
    low = fp.bitwiseAND(F.lit((1 << 63) - 1))
    pairs = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: i < i.bitwiseXOR(s))
    flips = F.transform(pairs, lambda i: low.bitwiseXOR(bit(i)).bitwiseXOR(bit(i.bitwiseXOR(s))))
    return F.when(s == 0, F.array(low)).otherwise(flips)


def _linked(fps: np.ndarray, threshold: int) -> np.ndarray:
    """For each of the fingerprints at one anchor, the least index that links within the threshold lead to."""
    n, root = len(fps), np.arange(len(fps))
    todo = np.ones(n, dtype=bool)
    for start in range(n):
        if not todo[start]:
            continue
        todo[start], stack = False, [start]
        while stack:
            i = stack.pop()
            root[i] = start
            rest = np.flatnonzero(todo)
            near = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= threshold]
            todo[near] = False
            stack.extend(near.tolist())
    return root


def _links(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            flat, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            a, b, start = [], [], 0
            for end in ends.tolist():
                if end - start == 2:
                    x, y = flat[start], flat[start + 1]
                    if int(x ^ y).bit_count() <= threshold if x ^ y >= 0 else int(np.uint64(x ^ y)).bit_count() <= threshold:
                        a.append(flat[start : start + 1])
                        b.append(flat[start + 1 : end])
                else:
                    own = flat[start:end]
                    root = _linked(own.view(np.uint64), threshold)
                    moved = root != np.arange(len(own))
                    a.append(own[moved])
                    b.append(own[root[moved]])
                start = end
            a, b = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (a, b))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id): every row of docs with the least doc_id that links lead to.

    Two fingerprints link at `threshold` (at most 2) or fewer differing bits. Work is on distinct fingerprints: exact
    copies meet there, in a pre-aggregated group-by. Each goes to its anchors; an anchor's group holds at most 2 x 2017 distinct
    fingerprints, as many as lie that close to it, so no group grows with the data. Groups give a
    spanning set of their links, not all pairs, and connected components join the groups.

    Null and empty texts have fingerprint 0 and link like any other. A null doc_id never is the least, unless the whole
    group has none; then component_id is null. Repeated rows stay. Other columns are ignored. Empty table: empty result.
    """
    grouped, _ = _grouped(docs, threshold)
    return grouped.select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, threshold: int) -> tuple[DataFrame, DataFrame]:
    """All rows as (doc_id, hash of the text, fp, component_id, root), and (fp, root, component_id) of distinct fingerprints."""
    if not 0 <= threshold <= 2:
        raise ValueError("the anchors cover thresholds 0 to 2")
    spark = docs.sparkSession
    own = cut(docs.select("doc_id", F.xxhash64("text").alias("hash"), fingerprint_udf(F.col("text")).alias("fp")), "simhash")
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash")
    spread = distinct.select("fp").repartition(width(spark), "fp").select("fp", F.explode(anchors(F.col("fp"))).alias("anchor"))
    met = spread.groupBy("anchor").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1).select("fps")
    label = components(met.mapInArrow(_links(threshold), "a long, b long").distinct())
    rooted = distinct.join(label, distinct.fp == label.node, "left").select("fp", "least", F.coalesce("component", "fp").alias("root"))
    rooted = cut(rooted, "simhash")
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(rooted.join(ids, "root").select("fp", "root", "component_id"), "simhash")
    return own.join(by_fp, "fp"), by_fp


def representatives(docs: DataFrame, threshold: int = 2) -> DataFrame:
    """The rows of docs that stay when one of each near-duplicate group does: that of the least doc_id, with all its columns.

    Among rows of that doc_id (or of a group without any) the least hash of the text decides, and of rows that repeat one as a whole, one stays.
    """
    last = F.lit((1 << 63) - 1)
    key = [F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), F.xxhash64("text").alias("_h")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *key)
    grouped = cut(_grouped(docs, threshold)[0].select(F.coalesce(F.col("doc_id").cast("long"), last).alias("_id"), F.col("hash").alias("_h"), "root"), "simhash")
    least = cut(grouped.groupBy("root").agg(F.min("_id").alias("_id")), "simhash")
    best = grouped.join(least, ["root", "_id"]).groupBy("root", "_id").agg(F.min("_h").alias("_h")).select("_id", "_h")
    kept = rows.join(best.hint("shuffle_hash"), ["_id", "_h"], "left_semi")
    if not grouped.groupBy("_id", "_h").count().where("count > 1").isEmpty():
        kept = kept.dropDuplicates(["_id", "_h"])
    return kept.select("_row.*")
