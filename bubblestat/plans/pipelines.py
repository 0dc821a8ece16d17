"""The analyses: from genotypes and traits to result tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import genotype, intervals, nets, stats, tables, walks
from ..sources.shared import ensure_checkpoints


@dataclass(frozen=True)
class Settings:
    """Limits of the filters, and their bounds."""

    min_individuals: int = 3
    min_haplotypes: int = 5
    max_children: int = 50
    cycle: int = 1
    budget: int = 10_000
    window: int = 1_000_000
    maf: float = 0.05
    table_threshold: float | None = None
    textbook_df: bool = False

    def __post_init__(self):
        for name, least in (("min_individuals", 2), ("min_haplotypes", 2), ("max_children", 2), ("budget", 2), ("cycle", 0), ("window", 1)):
            if getattr(self, name) < least:
                raise ValueError(f"{name} must be {least} or more")
        if not 0 <= self.maf <= 1:
            raise ValueError("maf must lie in 0 to 1")
        if self.table_threshold is not None and not 0 < self.table_threshold <= 1:
            raise ValueError("table_threshold must lie above 0, up to 1")


def present(site_paths: DataFrame, calls: DataFrame, samples: DataFrame) -> DataFrame:
    """(chr, site, path, sample, hap) of haplotypes on site paths. samples: sample_idx, sample."""
    haps = samples.select(F.explode(F.array(2 * F.col("sample_idx"), 2 * F.col("sample_idx") + 1)).alias("hap"), "sample")
    found = genotype.presence(site_paths, genotype.called_edges(calls), haps)
    named = found.join(haps, "hap").join(site_paths.select("chr", "site", "path_idx", "path"), ["chr", "site", "path_idx"])
    return named.select("chr", "site", "path_idx", "path", "sample", "hap")


def binary(present: DataFrame, traits: DataFrame, s: Settings) -> DataFrame:
    """(site, paths, g0, g1, chi2, df, p_chi2, p_fisher, group_paths) of sites that pass; traits: sample, is_case."""
    counted = tables.nonempty(tables.contingency(present, traits))
    vectors = tables.site_vectors(counted)
    kept = vectors.where(tables.passes_binary(F.col("g0"), F.col("g1"), s.min_individuals, s.min_haplotypes, s.maf))
    return stats.tested(kept).withColumn("group_paths", P.group_text(F.col("g0"), F.col("g1")))


def binary_bitmap(bits: DataFrame, masks: DataFrame, s: Settings) -> DataFrame:
    """binary() of presence in bitmaps and a cohort's masks."""
    vectors = tables.site_vectors(tables.nonempty(tables.bitmap_contingency(bits, masks)))
    kept = vectors.where(tables.passes_binary(F.col("g0"), F.col("g1"), s.min_individuals, s.min_haplotypes, s.maf))
    return stats.tested(kept).withColumn("group_paths", P.group_text(F.col("g0"), F.col("g1")))


def quantitative_bitmap(bits: DataFrame, traits: DataFrame, s: Settings) -> DataFrame:
    """quantitative() of presence in bitmaps; traits: sample_idx, pheno, cov array."""
    return stats.bitmap_quantitative(bits, traits, s.min_individuals, s.min_haplotypes, s.maf, s.textbook_df)


def _design(present: DataFrame, traits: DataFrame, s: Settings) -> DataFrame:
    """Rows of the regressions: dosages of the sites that pass, less merged and determined columns, with traits."""
    d = tables.dosages(present)
    d = d.join(tables.passes_dosage(d, s.min_individuals, s.min_haplotypes, s.maf).select("site"), "site", "left_semi")
    return stats.design_rows(tables.without_last(tables.merged_columns(d)), traits, d)


def quantitative(present: DataFrame, traits: DataFrame, s: Settings) -> DataFrame:
    """(site, n, p, r2, beta, se) by least squares; traits: sample, pheno, cov array (empty: none)."""
    return stats.regress(_design(present, traits, s), textbook=s.textbook_df)


def binary_covariates(present: DataFrame, traits: DataFrame, s: Settings) -> DataFrame:
    """(site, n, p, r2 null, beta, se) by logistic regression; traits: sample, pheno (0 or 1), cov array."""
    return stats.regress(_design(present, traits, s), logistic=True)


def eqtl(present: DataFrame, sites: DataFrame, genes: DataFrame, expression: DataFrame, cov: DataFrame, s: Settings) -> DataFrame:
    """(site, gene, n, p, r2, beta, se) for each gene near a site; sites: chr, site, start, end; expression: gene, sample, expr; cov: sample, cov.

    A chromosome without genes gives no rows."""
    pairs = intervals.near(sites, genes, s.window).select("site", "gene").distinct()
    wide = _design(present, cov, s)
    near = pairs.join(expression.select("gene", "sample", F.col("expr").alias("pheno")), "gene")  # narrow rows first: the designs are copied for samples that have a value
    rows = near.join(wide, ["site", "sample"])
    return stats.regress(rows, key=("site", "gene"), textbook=s.textbook_df)


def allele_paths(site_paths: DataFrame, bits: DataFrame) -> DataFrame:
    """(site, allele_paths): haplotypes on each path of a site's list, in its order, 0 for paths that nobody has. bits: presence in bitmaps."""
    n = bits.groupBy("site", "path_idx").agg(F.sum(F.bit_count("bits").cast("long")).alias("n"))
    each = site_paths.select("site", "path_idx").join(n, ["site", "path_idx"], "left").select("site", F.struct("path_idx", F.coalesce("n", F.lit(0)).alias("n")).alias("a"))
    return each.groupBy("site").agg(F.array_sort(F.collect_list("a")).alias("a")).select("site", F.col("a.n").alias("allele_paths"))


def counted(place: DataFrame, out: DataFrame) -> tuple[DataFrame, dict[str, int]]:
    """The results `out` with their sites' places, and how many results there are and how many sites have none: observed while the rows are made, so a repeated task counts once."""
    ensure_checkpoints(out.sparkSession)
    seen = Observation()
    both = place.join(out.withColumn("_tested", F.lit(True)), "site", "left").observe(seen, F.count_if(F.col("_tested")).alias("tested"), F.count_if(F.col("_tested").isNull()).alias("without"))
    rows = both.where("_tested").drop("_tested").checkpoint()
    return rows, seen.get


def regression_rows(present: DataFrame, near: DataFrame, reduced: bool) -> DataFrame:
    """(site, sample, path_idx, path, dosage) of the sites `near`; reduced: as the regression takes them, equal columns merged and the last one left out."""
    d = tables.dosages(present.join(near, "site", "left_semi"))
    return (tables.without_last(tables.merged_columns(d)) if reduced else d).select("site", "sample", "path_idx", "path", "dosage")


def graph(visits: DataFrame, samples: DataFrame, exact: bool) -> DataFrame:
    """Association of walks: exact sets as (site, walk, which), or counts with tests as binary() has them, case counts first.

    Haplotypes outside the cohort take no part. Sites of one walk are not tested."""
    own = walks.signatures(visits.join(samples.select("sample"), "sample", "left_semi"))
    if exact:
        return walks.exact_sets(own, samples)
    counts = walks.cohort_counts(own, samples).select("site", F.col("walk").alias("path"), F.col("n_case").alias("n0"), F.col("n_control").alias("n1"))
    vectors = tables.site_vectors(counts).where(F.size("g0") > 1)
    return stats.tested(vectors).withColumn("group_paths", P.group_text(F.col("g0"), F.col("g1")))


def site_nodes(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(site, node) that a site table names in a site's paths or as its bounds, and (site, start, end); the 0 of nested structure is no node."""
    ends = table.select("site", P.site_ends(F.col("site")).alias("e"), F.transform(P.digits(F.array_join("paths", ",")), lambda x: x.cast("long")).alias("ids"))
    nodes = ends.select("site", F.explode(F.array_distinct(F.concat("ids", F.array("e.start", "e.end")))).alias("node")).where(F.col("node") != P.WILDCARD)
    return nodes, ends.select("site", "e.start", "e.end")


def net_sites(tree: nets.Net) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(site, node) of the ends of a site's parts and its bounds, (site, start, end), and (site, parent, min_len, max_len, is_regular, depth) of a graph's own sites.

    A site is regular if each part of it leads from its start to its end only."""
    ends = tree.sites.select("site", nets.node_of(F.col("start")).alias("start"), nets.node_of(F.col("end")).alias("end"))
    parts = tree.traversals.join(tree.chains.select("chain", "owner"), "chain").join(tree.sites.select(F.col("start").alias("owner"), "site"), "owner").select("site", nets.node_of(F.col("key")).alias("node"))
    nodes = parts.unionByName(ends.select("site", F.explode(F.array("start", "end")).alias("node"))).distinct()
    between = tree.links.join(tree.sites.select("start", "end"), "start").where("a != start and b != end").select("start").distinct().withColumn("wild", F.lit(True))
    lengths, _ = nets.measured(tree)
    above = tree.sites.select(F.col("start").alias("parent"), F.col("site").alias("above"))
    rows = tree.sites.select("site", "start", "parent", "depth").join(above, "parent", "left").join(lengths, "start", "left").join(between, "start", "left")
    return nodes, ends, rows.select("site", F.col("above").alias("parent"), F.col("least").alias("min_len"), F.col("most").alias("max_len"), F.col("wild").isNull().alias("is_regular"), "depth")


def graph_visits(steps: DataFrame, nodes: DataFrame, bounds: DataFrame, tree: DataFrame) -> DataFrame:
    """Visits, as graph() takes them, of sites with their nodes and bounds by the paths of a graph. Regular sites of the tree are told by their start bound alone."""
    all_visits = walks.site_visits(steps, nodes, bounds)
    regular = tree.where("is_regular").select("site")
    visits = all_visits.join(regular, "site", "left_anti").unionByName(walks.opening(all_visits, bounds.join(regular, "site", "left_semi")).select(all_visits.columns))
    return visits.withColumn("sample", P.sample_of_path(F.col("path"))["sample"]).withColumnRenamed("path", "hap")


def graph_places(steps: DataFrame, nodes: DataFrame, bounds: DataFrame, tree: DataFrame, references: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of all paths through sites (site, start, end), (site, path, from_rank, to_rank, start, end), and where each site lies, as walks.coordinates() says."""
    placed = walks.step_offsets(steps.join(nodes.select("node", "len"), "node"))
    ends = bounds.select("site", F.explode(F.array_distinct(F.array("start", "end"))).alias("node"))
    pairs = walks.boundary_pairs(steps.select("path", "rank", "node").join(ends, "node").select("site", "path", "rank"))
    ranges = walks.path_ranges(pairs, placed)
    return ranges, walks.coordinates(ranges, tree.select("site", "parent"), references)


def corrected(results: DataFrame, p: str, top: float = 1e-5) -> tuple[DataFrame, DataFrame]:
    """results with p_adjusted, and those below top."""
    out = stats.bh_adjusted(results, p)
    return out, out.where(F.col("p_adjusted") < top)
