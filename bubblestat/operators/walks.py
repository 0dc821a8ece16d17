"""Walks of embedded paths through a graph: offsets, boundary pairs, signatures and partitions of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoints


def step_offsets(steps: DataFrame) -> DataFrame:
    """steps (path, rank, len …) with offset: the length of all steps of the path before it."""
    order = W.partitionBy("path").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    return steps.withColumn("offset", F.coalesce(F.sum("len").over(order), F.lit(0)))


def neighbours(steps: DataFrame) -> DataFrame:
    """steps (path, rank, node …) with the previous and the next node on the path."""
    order = W.partitionBy("path").orderBy("rank")
    return steps.withColumns({"previous": F.lag("node").over(order), "next": F.lead("node").over(order)})


def boundary_pairs(bound_steps: DataFrame) -> DataFrame:
    """(site, path, from_rank, to_rank) of steps (site, path, rank) on either bound of a site: in order, first with second, third with fourth and so on."""
    order = W.partitionBy("site", "path").orderBy("rank")
    placed = bound_steps.withColumns({"_k": F.row_number().over(order), "to_rank": F.lead("rank").over(order)})
    return placed.where("_k % 2 = 1 and to_rank is not null").select("site", "path", F.col("rank").alias("from_rank"), "to_rank")


def site_visits(steps: DataFrame, site_nodes: DataFrame, bounds: DataFrame) -> DataFrame:
    """(site, path, child, direction, offset, next): each visit of a site's nodes between its bounds, and where the path goes from there.

    steps: path, rank, node, rev. site_nodes: site, node, bounds included; what isn't listed (the inside of nested sites) is skipped. bounds: site, start,
    end. Steps on bounds pair up as in boundary_pairs; a last one without a partner has no visits. A pair that starts at the end bound is walked
    backwards: its order and orientations are turned, so that both ways through a site are one walk. Steps meet nodes by one equality join."""
    ends = (F.col("node") == F.col("start")) | (F.col("node") == F.col("end"))
    met = steps.select("path", "rank", "node", "rev").join(site_nodes.select("site", "node").distinct(), "node").join(bounds.select("site", "start", "end"), "site").withColumn("bound", ends)
    order = W.partitionBy("site", "path").orderBy("rank")
    before = F.coalesce(F.count_if(F.col("bound")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    inside = met.withColumn("before", before).where("bound or before % 2 = 1").withColumn("pair", F.floor(F.col("before") / 2))
    pair = W.partitionBy("site", "path", "pair")
    first = F.first("node").over(pair.orderBy("rank").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    whole = inside.withColumn("n", F.count_if(F.col("bound")).over(pair)).withColumn("back", (first == F.col("end")) & (F.col("start") != F.col("end"))).where("n = 2")
    turned = whole.withColumns({"way": F.when(F.col("back"), -F.col("rank")).otherwise(F.col("rank")), "direction": (F.col("rev") != F.col("back")).cast("int")})
    after = F.lead(F.struct("node", "direction")).over(pair.orderBy("way"))
    rows = turned.withColumn("after", after).where("after is not null")
    next_node = F.concat(F.when(F.col("after.direction") == 1, "<").otherwise(">"), F.col("after.node").cast("string"))
    return rows.select("site", "path", F.col("node").alias("child"), "direction", F.struct("pair", "way").alias("offset"), next_node.alias("next"))


def opening(visits: DataFrame, bounds: DataFrame) -> DataFrame:
    """Visits of the start bound alone. In a site without branches inside its branches they tell walks apart as all visits do."""
    return visits.join(bounds.select("site", F.col("start").alias("child")), ["site", "child"], "left_semi")


def path_ranges(pairs: DataFrame, steps: DataFrame) -> DataFrame:
    """(site, path, from_rank, to_rank, start, end) of pairs of steps (site, path, from_rank, to_rank): offsets of the letters between them, bounds left out.

    steps: path, rank, offset, len."""
    left = steps.select("path", F.col("rank").alias("from_rank"), (F.col("offset") + F.col("len")).alias("start"))
    right = steps.select("path", F.col("rank").alias("to_rank"), F.col("offset").alias("end"))
    return pairs.join(left, ["path", "from_rank"]).join(right, ["path", "to_rank"]).select("site", "path", "from_rank", "to_rank", "start", "end")


def widest(ranges: DataFrame) -> DataFrame:
    """(site, path, start, end): of each site its first path, by name, from the least start to the greatest end."""
    each = ranges.groupBy("site", "path").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return each.groupBy("site").agg(F.min(F.struct("path", "start", "end")).alias("r")).select("site", "r.*")


def coordinates(ranges: DataFrame, tree: DataFrame, references: DataFrame) -> DataFrame:
    """(site, path, start, end, is_own): where each site of a tree (site, parent) lies.

    On a reference path, if the site has a range there; else where its nearest ancestor has one; else on its first path of any name. A site without any has
    no row. is_own: the range is the site's, not an ancestor's."""
    known = widest(ranges.join(references.select("path").distinct(), "path", "left_semi"))
    placed = known.select("site", F.lit(True).alias("hit"))
    climbed = nearest_placed(tree.join(placed, "site", "left").select(F.col("site").alias("id"), "parent", F.coalesce("hit", F.lit(False)).alias("placed")))
    on_reference = climbed.join(known.withColumnRenamed("site", "placed_id"), "placed_id").select(F.col("id").alias("site"), "path", "start", "end", "is_own")
    rest = climbed.where("placed_id is null").select(F.col("id").alias("site"))
    return on_reference.unionByName(widest(ranges.join(rest, "site", "left_semi")).withColumn("is_own", F.lit(True)))


def signatures(visits: DataFrame) -> DataFrame:
    """(site, hap, sample, walk): how a haplotype walks a site.

    visits: site, hap, sample, child, direction, offset, next: each visit of a child of the site, with where it goes. Two haplotypes walk
    alike if, for each child and direction, their next nodes agree in order."""
    by_child = visits.groupBy("site", "hap", "sample", "child", "direction").agg(F.array_sort(F.collect_list(F.struct("offset", "next"))).alias("v"))
    one = F.concat_ws("/", F.col("child").cast("string"), F.col("direction").cast("string"), F.array_join(F.transform("v", lambda x: x["next"].cast("string")), ">"))
    return by_child.withColumn("_one", one).groupBy("site", "hap", "sample").agg(F.array_join(F.array_sort(F.collect_list("_one")), " ").alias("walk"))


def partitions(walks: DataFrame) -> DataFrame:
    """(site, walk, part, samples): sets of sample names that share a walk, numbered by their first sample. A sample with two different walks is in two sets."""
    sets = walks.groupBy("site", "walk").agg(F.array_sort(F.collect_set("sample")).alias("samples"))
    order = W.partitionBy("site").orderBy(F.get("samples", F.lit(0)), "walk")
    return sets.withColumn("part", F.row_number().over(order) - 1)


def cohort_counts(walks: DataFrame, samples: DataFrame) -> DataFrame:
    """(site, walk, n_case, n_control): distinct sample names of each walk. Paths outside the cohort don't count."""
    both = walks.select("site", "walk", "sample").distinct().join(samples, "sample")
    return both.groupBy("site", "walk").agg(F.count_if("is_case").alias("n_case"), F.count_if(~F.col("is_case")).alias("n_control"))


def exact_sets(walks: DataFrame, samples: DataFrame) -> DataFrame:
    """(site, walk, which): walks taken by all cases and nobody else, or by all controls and nobody else. Sites of one walk separate nobody and have none."""
    cases, controls = samples.agg(F.count_if("is_case"), F.count_if(~F.col("is_case"))).first()
    hit = F.when((F.col("n_control") == 0) & (F.col("n_case") == cases) & F.lit(cases > 0), "case").when((F.col("n_case") == 0) & (F.col("n_control") == controls) & F.lit(controls > 0), "control")
    counts = cohort_counts(walks, samples)
    several = counts.groupBy("site").agg(F.count("*").alias("n")).where("n > 1")
    return counts.withColumn("which", hit).where("which is not null").join(several, "site", "left_semi").select("site", "walk", "which")


def descend(sites: DataFrame, hits) -> list[DataFrame]:
    """Site testing level by level: hits(sites of a level) are its exact hits; children of a hit, and of sites too small, are not tested.

    sites: site, parent (null at the top), depth, eligible. Returns the hits of each level, down to the last that has a site to test."""
    ensure_checkpoints(sites.sparkSession)
    out, open_sites = [], sites.where("parent is null")
    while True:
        level = open_sites.where(F.col("eligible")).checkpoint()
        if out and level.isEmpty():
            return out
        found = hits(level)
        out.append(found)
        going = level.join(found.select("site").distinct(), "site", "left_anti").select(F.col("site").alias("parent"))
        open_sites = sites.join(going, "parent", "left_semi")


def reached(sites: DataFrame) -> DataFrame:
    """(site) of the sites that a descent without hits tests: those that are eligible, as is all above them. sites as descend() takes them."""
    levels: list[DataFrame] = []

    def none(level: DataFrame) -> DataFrame:
        levels.append(level.select("site"))
        return level.select("site").limit(0)

    descend(sites, none)
    out = levels[0]
    for level in levels[1:]:
        out = out.unionByName(level)
    return out


def on_reference(nodes: DataFrame, steps: DataFrame, references: DataFrame) -> DataFrame:
    """(node, path, offset): each node's first place on a reference path, by path name and rank."""
    some = steps.join(references, "path", "left_semi").join(nodes.select("node").distinct(), "node", "left_semi")
    best = some.groupBy("node").agg(F.min(F.struct("path", "rank", "offset")).alias("b"))
    return best.select("node", "b.path", "b.offset")


def nearest_placed(tree: DataFrame) -> DataFrame:
    """(id, placed_id, is_own): for each node of a tree (id, parent, placed) itself or its nearest ancestor that is placed; null if none.

    Each round a node that still climbs takes over where its ancestor has got to, so rounds follow the logarithm of the depth. A parent that isn't in the
    tree counts as none; nodes that climb in a circle have none."""
    ensure_checkpoints(tree.sparkSession)
    up = tree.select(F.col("id").alias("up"), F.lit(True).alias("known")).distinct()
    own = tree.join(up, F.col("parent") == F.col("up"), "left").select("id", F.when(F.col("placed"), F.col("id")).when(F.col("known"), F.col("parent")).alias("at"), (F.col("placed") | F.col("known").isNull()).alias("done"))
    now, before = own.checkpoint(), None
    while (left := now.where("not done").count()) and left != before:  # each round ends some climbs, unless all that are left go round
        before = left
        there = now.select(F.col("id").alias("at"), F.col("at").alias("next"), F.col("done").alias("ends"))
        now = now.where("done").unionByName(now.where("not done").join(there, "at").select("id", F.col("next").alias("at"), F.col("ends").alias("done"))).checkpoint()
    return now.select("id", F.when(F.col("done"), F.col("at")).alias("placed_id")).withColumn("is_own", F.coalesce(F.col("placed_id") == F.col("id"), F.lit(False)))


def shared_paths(start_steps: DataFrame, end_steps: DataFrame) -> DataFrame:
    """(site, path): the first path, by name, on both bounds of a site."""
    both = start_steps.select("site", "path").intersect(end_steps.select("site", "path"))
    return both.groupBy("site").agg(F.min("path").alias("path"))


def sequences(ranges: DataFrame, steps: DataFrame, nodes: DataFrame, width: int = 80) -> DataFrame:
    """(site, path, from_rank, to_rank, sequence): letters strictly between two steps of a path, wrapped."""
    inner = ranges.join(steps.select("path", "rank", "node"), "path").where("rank > from_rank and rank < to_rank").join(nodes.select("node", "seq"), "node")
    joined = inner.groupBy("site", "path", "from_rank", "to_rank").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "seq"))), lambda x: x["seq"]), "").alias("s"))
    kept = ranges.join(joined, ["site", "path", "from_rank", "to_rank"], "left")
    return kept.select("site", "path", "from_rank", "to_rank", F.regexp_replace(F.coalesce("s", F.lit("")), f"(.{{{width}}})(?!$)", "$1\n").alias("sequence"))
