"""Contingency and dosage tables of sites, and their filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def path_columns(rows: DataFrame) -> list[str]:
    """What tells and orders the paths of a site: path_idx, its place in the site's list, where there is one, and path."""
    return [c for c in ("path_idx", "path") if c in rows.columns]


def contingency(present: DataFrame, samples: DataFrame, keys: tuple[str, ...] | None = None) -> DataFrame:
    """(keys, n0, n1): carriers among controls and cases. present: keys (site and path_columns()), hap, sample; samples: sample, is_case. A haplotype counts for each path it has."""
    keys = keys or ("site", *path_columns(present))
    both = present.join(samples.select("sample", "is_case"), "sample")
    return both.groupBy(*keys).agg(F.count_if(~F.col("is_case")).alias("n0"), F.count_if("is_case").alias("n1"))


def bitmap_contingency(bits: DataFrame, masks: DataFrame) -> DataFrame:
    """contingency() of presence in bitmaps (site, path_columns(), word, bits) and a cohort's masks (word, known, cases): bits counted, no row for a haplotype."""
    both = bits.join(masks, "word")
    ones = lambda mask: F.sum(F.bit_count(F.col("bits").bitwiseAND(mask)).cast("long"))
    return both.groupBy("site", *path_columns(bits)).agg(ones(F.col("known").bitwiseAND(F.bitwise_not("cases"))).alias("n0"), ones(F.col("cases")).alias("n1"))


def nonempty(table: DataFrame) -> DataFrame:
    return table.where("n0 + n1 > 0")


def site_vectors(table: DataFrame, site: str = "site", path: str = "path") -> DataFrame:
    """(site, paths, g0, g1): a site's counts as arrays in path order; a site has few paths."""
    v = F.array_sort(F.collect_list(F.struct(*[c for c in table.columns if c == "path_idx"], path, "n0", "n1")))
    return table.groupBy(site).agg(v.alias("v")).select(site, F.col(f"v.{path}").alias("paths"), F.col("v.n0").alias("g0"), F.col("v.n1").alias("g1"))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x)


def passes_binary(g0: Column, g1: Column, min_individuals: int, min_haplotypes: int, maf: float) -> Column:
    """At least two paths, enough haplotypes and (pairs of haplotypes) individuals, and two paths whose share of cases or of controls, whichever is less, exceeds maf."""
    total = _sum(g0) + _sum(g1)
    varied = F.size(F.filter(F.zip_with(g0, g1, lambda a, b: F.least(a, b) / (a + b)), lambda f: f > maf))
    return (F.size(g0) >= 2) & (F.floor(total / 2) >= min_individuals) & (total >= min_haplotypes) & (varied >= 2)


def dosages(present: DataFrame) -> DataFrame:
    """(site, sample, path_columns(), n, dosage): haplotypes of a sample on a path, and that over all of the sample's at the site. Samples without any have no row."""
    n = present.groupBy("site", "sample", *path_columns(present)).agg(F.count("*").alias("n"))
    return n.withColumn("dosage", F.col("n") / F.sum("n").over(W.partitionBy("site", "sample")))


def allele_counts(paths: DataFrame, present: DataFrame) -> DataFrame:
    """(site, path, n) for every path of a site, those that nobody has included."""
    n = present.groupBy("site", "path").agg(F.count("*").alias("n"))
    return paths.select("site", "path").distinct().join(n, ["site", "path"], "left").select("site", "path", F.coalesce("n", F.lit(0)).alias("n"))


def passes_dosage(dosage: DataFrame, min_individuals: int, min_haplotypes: int, maf: float) -> DataFrame:
    """Sites with two columns or more, enough individuals and sum, and two columns whose share of the sum, or what is left of it, exceeds maf."""
    columns = dosage.where("dosage > 0").groupBy("site", "path").agg(F.sum("dosage").alias("s"))
    rows = dosage.groupBy("site").agg(F.countDistinct("sample").alias("n_ind"))
    share = F.col("s") / F.sum("s").over(W.partitionBy("site"))
    sites = columns.withColumn("f", share).groupBy("site").agg(F.count("*").alias("n_paths"), F.sum("s").alias("total"), F.count_if(F.least("f", 1 - F.col("f")) > maf).alias("varied"))
    good = sites.join(rows, "site").where((F.col("n_paths") >= 2) & (F.col("n_ind") >= min_individuals) & (F.col("total") >= min_haplotypes) & (F.col("varied") >= 2))
    return good.select("site", "n_paths", "n_ind", F.col("total").alias("dosage_sum"), "varied")


def merged_columns(dosage: DataFrame) -> DataFrame:
    """(site, path_columns(), sample, dosage) with equal columns of a site (of three or more) summed into the first of them.

    A column's signature is two hashes over its (sample, dosage) pairs, pre-aggregated, so no column meets in one task; columns whose 128 bits agree count as equal."""
    own = path_columns(dosage)
    pair = [F.xxhash64(F.lit(i), "sample", F.round("dosage", 9)) for i in (1, 2)]
    signs = dosage.where("dosage > 0").groupBy("site", *own).agg(*[F.bit_xor(h).alias(f"h{i}") for i, h in enumerate(pair)], F.count("*").alias("c"))
    many = W.partitionBy("site")
    first = F.min(F.struct(*own)).over(W.partitionBy("site", "h0", "h1", "c"))
    lead = signs.select("site", *own, F.when(F.count("*").over(many) >= 3, first).otherwise(F.struct(*own)).alias("lead"))
    return dosage.where("dosage > 0").join(lead, ["site", *own]).groupBy("site", "lead", "sample").agg(F.sum("dosage").alias("dosage")).select("site", "lead.*", "sample", "dosage")


def without_last(dosage: DataFrame) -> DataFrame:
    """Without the last column of each site, which the others determine."""
    order = path_columns(dosage)[0]
    last = dosage.groupBy("site").agg(F.max(order).alias("last"))
    return dosage.join(last, "site").where(F.col(order) < F.col("last")).drop("last")


def site_stats(sites: DataFrame) -> DataFrame:
    """(chr, n_sites, n_paths) of (chr, site, path)."""
    return sites.groupBy("chr").agg(F.countDistinct("site").alias("n_sites"), F.countDistinct("site", "path").alias("n_paths"))
