"""Paths through sites of a graph, by a bounded frontier that grows a step at a time in all sites together."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoints


def enumerated(links: DataFrame, bounds: DataFrame, cycle: int = 1, budget: int = 10_000, max_children: int = 50) -> tuple[DataFrame, DataFrame]:
    """(site, path array) of all walks from a site's start to its end, and (site, reason) of sites that are given up.

    links: site, a, b (elements of a site that follow each other); bounds: site, start, end. An element may recur `cycle` times; only the
    end bound may follow one that has. A site goes if it has more than max_children elements or if more than budget + 1 unfinished walks are met, its start included;
    one with fewer than two walks is dropped. Each round is one join of the frontier with the links of its last elements.
    """
    ensure_checkpoints(links.sparkSession)
    sizes = links.select("site", F.explode(F.array("a", "b")).alias("e")).distinct().groupBy("site").agg(F.count("*").alias("n"))
    inner = sizes.join(bounds, "site").withColumn("n", F.col("n") - 2)
    many = inner.where(F.col("n") > max_children).select("site", F.concat_ws(" ", F.lit("too_many_children ="), F.col("n").cast("string"), F.lit("children")).alias("reason"))
    own = links.distinct()
    front = bounds.join(many, "site", "left_anti").select("site", "end", F.array("start").alias("path"))
    done, met = None, front.groupBy("site").agg(F.count("*").alias("c"))
    while True:  # ends, as recurrence and budget bound each site's walks
        moved = front.withColumn("a", F.element_at("path", -1)).join(own, ["site", "a"])
        again = F.size(F.filter("path", lambda x: x == F.col("b")))
        moved = moved.where((again <= cycle) | (F.col("b") == F.col("end"))).select("site", "end", F.concat("path", F.array("b")).alias("path"), (F.col("b") == F.col("end")).alias("last"))
        moved = moved.checkpoint()
        ended = moved.where("last").select("site", "path")
        done = ended if done is None else done.unionByName(ended)
        front = moved.where("not last").select("site", "end", "path")
        met = met.unionByName(moved.where("not last").groupBy("site").agg(F.count("*").alias("c"))).groupBy("site").agg(F.sum("c").alias("c")).checkpoint()
        over = met.where(F.col("c") > budget + 1).select("site")
        front = front.join(over, "site", "left_anti")
        if front.isEmpty():
            break
    tired = over.join(inner, "site").select("site", F.concat_ws(" ", F.lit("iteration_calculation_out ="), F.col("n").cast("string"), F.lit("children")).alias("reason"))
    few = done.groupBy("site").agg(F.countDistinct("path").alias("c")).where("c < 2").select("site")
    return done.distinct().join(over.unionByName(few), "site", "left_anti"), many.unionByName(tired)


def path_lengths(paths: DataFrame, elements: DataFrame) -> DataFrame:
    """(site, path, min_len, max_len, n_steps): the length between the bounds; elements (site, element, min_len, max_len) may be chains."""
    inner = paths.select("site", "path", F.posexplode("path").alias("i", "element")).where((F.col("i") > 0) & (F.col("i") < F.size("path") - 1))
    sums = inner.join(elements, ["site", "element"]).groupBy("site", "path").agg(F.sum("min_len").alias("min_len"), F.sum("max_len").alias("max_len"))
    return paths.join(sums, ["site", "path"], "left").select("site", "path", F.coalesce("min_len", F.lit(0)).alias("min_len"), F.coalesce("max_len", F.lit(0)).alias("max_len"), F.size("path").alias("n_steps"))


def inherited(tree: DataFrame) -> DataFrame:
    """(id, chr, position, is_ref): each node's own position, or that of the nearest ancestor with one. tree: id, parent, chr, position."""
    from .walks import nearest_placed

    climbed = nearest_placed(tree.select("id", "parent", F.col("chr").isNotNull().alias("placed")))
    return climbed.join(tree.select(F.col("id").alias("placed_id"), "chr", "position"), "placed_id", "left").select("id", "chr", "position", F.col("is_own").alias("is_ref"))
