"""How results compare with truth and with each other, and what plots need."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ranks


def truth_labels(frequencies: DataFrame, threshold: float = 0.2) -> DataFrame:
    """(start, next, differs) of (start, next, group, freq): whether the two groups' frequencies differ by more than threshold."""
    by = frequencies.groupBy("start", "next").agg(F.max(F.when(F.col("group") == 0, F.col("freq"))).alias("f0"), F.max(F.when(F.col("group") == 1, F.col("freq"))).alias("f1"))
    return by.where("f0 is not null and f1 is not null").select("start", "next", (F.abs(F.col("f0") - F.col("f1")) > threshold).alias("differs"))


def forks_in_sites(forks: DataFrame, sites: DataFrame) -> DataFrame:
    """(start, next, site) of truth forks whose two nodes follow each other on a path of the site, either way. Meets on the edge, not by ranges."""
    s = sites.select("site", F.explode(F.split("paths", ",")).alias("p"))
    ids = F.transform(F.regexp_extract_all("p", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))
    pairs = s.select("site", ids.alias("i")).where(F.size("i") > 1)
    edges = pairs.select("site", F.explode(F.zip_with(F.slice("i", 1, F.size("i") - 1), F.slice("i", 2, F.size("i") - 1), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))).alias("e")).select("site", "e.*").distinct()
    return forks.join(edges, (F.least("start", "next") == F.col("a")) & (F.greatest("start", "next") == F.col("b"))).select("start", "next", "site").distinct()


def fork_pairs_in_sites(forks: DataFrame, sites: DataFrame) -> DataFrame:
    """(start, next_a, next_b, site) of truth forks whose both branches lie in a site: one path holds start and next_a, one start and next_b.

    forks: start, next_a, next_b. sites: site, first, last, paths (comma list); the bounds must reach around start and next_a, either way. Forks meet
    paths by an equality on the node they start from, not by ranges."""
    p = sites.select("site", "first", "last", F.posexplode(F.split("paths", ",")).alias("path_idx", "path"))
    p = p.withColumn("ids", F.array_distinct(F.transform(F.regexp_extract_all("path", F.lit("([0-9]+)"), F.lit(1)), lambda x: x.cast("long"))))
    met = p.select("site", "first", "last", "ids", F.explode("ids").alias("start")).join(forks.distinct(), "start")
    around = ((F.col("first") <= F.col("start")) & (F.col("last") >= F.col("next_a"))) | ((F.col("last") <= F.col("start")) & (F.col("first") >= F.col("next_a")))
    held = met.where(around).groupBy("start", "next_a", "next_b", "site").agg(F.bool_or(F.array_contains("ids", F.col("next_a"))).alias("a"), F.bool_or(F.array_contains("ids", F.col("next_b"))).alias("b"))
    return held.where("a and b").select("start", "next_a", "next_b", "site")


def with_paths(results: DataFrame, sites: DataFrame) -> DataFrame:
    """All results, with the paths of their sites where the site table has them."""
    return results.join(sites.select("site", "paths"), "site", "left")


def structural(sites: DataFrame, least: int = 50) -> DataFrame:
    """Sites (…, type: comma list of lengths or ranges) of which two lengths differ by `least` or more."""
    n = F.transform(F.split(F.replace("type", F.lit("/"), F.lit(",")), ","), lambda x: x.try_cast("long"))
    return sites.where(F.array_max(n) - F.array_min(n) >= least)


def confusion(results: DataFrame, thresholds: tuple[float, ...] = (1e-2, 1e-5, 1e-8)) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) of (p, truth); null p is never significant. One pass."""
    t = F.explode(F.array(*[F.lit(x) for x in thresholds])).alias("threshold")
    rows = results.select("truth", F.coalesce("p", F.lit(1.0)).alias("p"), t).groupBy("threshold")
    hit, true = F.col("p") < F.col("threshold"), F.col("truth")
    c = rows.agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"), F.count_if(~hit & ~true).alias("tn"))
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rated = c.withColumn("precision", share(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", share(F.col("tp"), F.col("tp") + F.col("fn")))
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def effect_summary(results: DataFrame, threshold: float) -> DataFrame:
    """(class, n, mean_effect, min_effect, max_effect) of (p, truth, effect) by outcome: TP, FP, FN or TN."""
    hit = F.coalesce(F.col("p") < threshold, F.lit(False))
    kind = F.when(hit & F.col("truth"), "TP").when(hit, "FP").when(F.col("truth"), "FN").otherwise("TN")
    return results.groupBy(kind.alias("class")).agg(F.count("*").alias("n"), F.avg("effect").alias("mean_effect"), F.min("effect").alias("min_effect"), F.max("effect").alias("max_effect"))


def manhattan(results: DataFrame) -> DataFrame:
    """(chr, pos, y) of results with a p: -log10 of p, which is 1e-300 at least."""
    return results.where("p is not null").select("chr", "pos", (-F.log10(F.greatest("p", F.lit(1e-300)))).alias("y"))


def qq(results: DataFrame, group: str) -> DataFrame:
    """(group, expected, observed) for each p, by plotting positions (r - a) / (n + 1 - 2a), a 3/8 up to 10 values and 1/2 beyond."""
    placed = ranks.ranked(results.where("p is not null").select(group, "p", "id"), group, ["p", "id"])
    a = F.when(F.col("_n") <= 10, F.lit(0.375)).otherwise(F.lit(0.5))
    ranked = placed.select(group, "p", F.col("_k").alias("r"), F.col("_n").alias("n"), a.alias("a"))
    return ranked.select(group, (-F.log10((F.col("r") - F.col("a")) / (F.col("n") + 1 - 2 * F.col("a")))).alias("expected"), (-F.log10(F.greatest("p", F.lit(1e-300)))).alias("observed"))


def genotype_classes(dosage: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """(site, genotype, n): samples by genotype. One path of dosage 1 is a/a, two of a half each a/b, anything else Other."""
    held = F.array_sort(F.collect_list(F.when(F.col("dosage") > tolerance, F.struct("path", "dosage"))))
    rows = dosage.groupBy("site", "sample").agg(held.alias("h"))
    near = lambda i, v: F.abs(F.get("h", F.lit(i))["dosage"] - v) < tolerance
    path = lambda i: F.get("h", F.lit(i))["path"]
    kind = F.when((F.size("h") == 1) & near(0, 1.0), F.concat_ws("/", path(0), path(0))).when((F.size("h") == 2) & near(0, 0.5) & near(1, 0.5), F.concat_ws("/", path(0), path(1))).otherwise("Other")
    return rows.groupBy("site", kind.alias("genotype")).agg(F.count("*").alias("n"))


def volcano(results: DataFrame, threshold: float, keep: list[str] | None = None) -> DataFrame:
    """(keep …, effect, y, significant) of results with a p and an effect: -log10 of p, which is 1e-300 at least."""
    y = -F.log10(F.greatest("p", F.lit(1e-300)))
    return results.where("p is not null and effect is not null").select(*keep or [], "effect", y.alias("y"), (F.col("p") < threshold).alias("significant"))


def histogram(rows: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """(bin from 0, n); the last bin holds its upper end."""
    b = F.least(F.floor((F.col(column) - low) / ((high - low) / bins)), F.lit(bins - 1))
    return rows.where(F.col(column).between(low, high)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def differences(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(column, n_common, n_differ) of two tables by key; two nulls are equal. One join, one aggregate."""
    l, r = (d.select(key, *[F.col(c).alias(f"{side}_{c}") for c in columns]) for d, side in ((left, "l"), (right, "r")))
    both = l.join(r, key).agg(F.count("*").alias("n"), *[F.count_if(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias(c) for c in columns])
    return both.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("n").alias("n_common"), F.col(c).alias("n_differ")) for c in columns])).alias("x")).select("x.*")


def diploid(calls: DataFrame) -> DataFrame:
    """(site, sample, genotype) of haploid columns (site, column, allele): columns 2k and 2k + 1 of a site are the two alleles of sample k."""
    pairs = calls.groupBy("site", F.floor(F.col("column") / 2).alias("sample")).agg(F.array_sort(F.collect_list(F.struct("column", "allele"))).alias("a"))
    return pairs.select("site", "sample", F.array_join(F.transform("a", lambda x: x["allele"].cast("string")), "|").alias("genotype"))


def bonferroni(results: DataFrame, by: str) -> DataFrame:
    """results with p_bonferroni: p times the group's number of tests, at most 1."""
    return ranks.counted(results, by, F.count("p"), "_n").withColumn("p_bonferroni", F.least(F.lit(1.0), F.col("p") * F.col("_n"))).drop("_n")
