"""Connected components by alternating large and small stars (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, forget


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node that has an edge, with the least node it can reach.

    Edges are undirected; loops, repeats and rows with a null end are ignored. Each round is two grouped
    minima and two joins on distinct edges. The minima are written before they are joined, so that both sides of
    a join are plain exchanges, which Spark splits where a node has very many edges.
    No table: empty result.
    """
    x, y = F.col(a), F.col(b)
    now = cut(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "cc")
    mark = _mark(now)
    while mark[0]:
        star = cut(_star(now, large=True), "cc")
        nxt = cut(_star(star, large=False), "cc")
        forget(now)
        forget(star)
        now, before, mark = nxt, mark, _mark(nxt)
        if mark == before:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def _mark(edges: DataFrame) -> tuple:
    h = F.xxhash64("u", "v")
    row = edges.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Links each node's larger (large) or smaller-or-equal neighbours to the least of all its neighbours and itself.

    Edges are (u, v) with u > v."""
    if large:
        sides = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc")
        out = sides.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = cut(edges.groupBy("u").agg(F.min("v").alias("m")), "cc")
        out = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
    return out.where("u != v").distinct()
