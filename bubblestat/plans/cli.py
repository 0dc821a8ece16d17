"""Command line: `vcf` and `graph` analyses and `correct`."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import genotype, nets, stats, walks
from ..sources import readers, sinks
from ..sources.shared import ensure_checkpoints
from . import pipelines


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="bubblestat", description="Association of graph paths with traits")
    sub = top.add_subparsers(dest="command", required=True)
    v = sub.add_parser("vcf", help="association from a VCF and the sites of a table or a graph, or the table of a graph's sites alone")
    v.add_argument("-p", "--graph", help="GFA; with -d")
    v.add_argument("-d", "--bounds", help="bounds of the graph's sites, as a table or as JSON lines")
    v.add_argument("-s", "--sites")
    v.add_argument("-v", "--vcf")
    v.add_argument("-r", "--references", help="names of the paths that give positions, one a line; without it paths with plain names do")
    v.add_argument("-i", "--max-children", type=int, default=50)
    v.add_argument("-y", "--cycle", type=int, default=1)
    v.add_argument("-l", "--budget", type=int, default=10_000)
    v.add_argument("-g", "--gaf", help="file for the paths of a binary analysis as alignments; with -b and -p")
    v.add_argument("-k", "--kinship", help="read and checked only")
    trait = v.add_mutually_exclusive_group()
    trait.add_argument("-b", "--binary")
    trait.add_argument("-q", "--quantitative")
    trait.add_argument("-e", "--expression")
    v.add_argument("-G", "--genes")
    v.add_argument("-c", "--covariates")
    v.add_argument("-C", "--covariate-names", default="")
    v.add_argument("-I", "--min-individuals", type=int, default=3)
    v.add_argument("-H", "--min-haplotypes", type=int, default=5)
    v.add_argument("-M", "--maf", type=float, default=0.05)
    v.add_argument("-w", "--window", type=int, default=1_000_000)
    v.add_argument("-T", "--table-threshold", type=float)
    v.add_argument("-o", "--output", default="output")
    g = sub.add_parser("graph", help="association from the paths of a graph and a site table")
    g.add_argument("-g", "--graph", required=True, help="GFA")
    g.add_argument("-s", "--sites", help="table of sites; without it they come from the graph and -d")
    g.add_argument("-d", "--tree", help="with -s nested sites with lengths, without which all sites are at the top and none has lengths; else bounds of the graph's sites, as a table or as JSON lines")
    g.add_argument("-b", "--binary", required=True)
    g.add_argument("-T", "--test", choices=["exact", "chi2"], default="exact")
    g.add_argument("-O", "--output-format", choices=["tsv", "fasta"], default="tsv")
    g.add_argument("-l", "--allele-size-limit", type=int, default=0)
    g.add_argument("-r", "--reference-sample", help="whose paths give positions; without it paths with plain names do")
    g.add_argument("--references", help="names of the paths that give positions, one a line")
    g.add_argument("-o", "--output", default="output")
    c = sub.add_parser("correct", help="adjusted p-values of a result table, in a column of their own")
    c.add_argument("-t", "--table", required=True)
    c.add_argument("-p", "--p-column", required=True, help="name, or number from 1, of the column of p-values")
    c.add_argument("-a", "--adjusted-column", help="name, or number from 1, of a column that the adjusted values replace; without it they are a new one")
    c.add_argument("-o", "--output", required=True)
    sub.add_parser("version")
    return top


def checked(args: argparse.Namespace) -> argparse.Namespace:
    """Combinations that make no sense end with a message."""
    if args.command == "vcf":
        if bool(args.covariates) != bool(args.covariate_names):
            raise SystemExit("-c and -C go together")
        if bool(args.expression) != bool(args.genes):
            raise SystemExit("-e and -G go together")
        trait = bool(args.binary or args.quantitative or args.expression)
        if bool(args.graph) != bool(args.bounds):
            raise SystemExit("-p and -d go together")
        if bool(args.sites) == bool(args.graph):
            raise SystemExit("sites come from -s, or from -p and -d")
        if bool(args.vcf) != trait or args.sites and not args.vcf:
            raise SystemExit("an analysis takes -v and one of -b, -q and -e; only -p and -d stand alone")
        if args.gaf and not (args.binary and args.graph):
            raise SystemExit("-g takes -b and -p")
    if args.command == "graph" and not (args.sites or args.tree):
        raise SystemExit("sites come from -s, or from -d")
    return args


def graph_sites(spark: SparkSession, args: argparse.Namespace, s: pipelines.Settings) -> DataFrame:
    """The site table of a graph, and the sites given up, written and read back as the analyses read them."""
    ensure_checkpoints(spark)
    nodes, _, steps = readers.gfa(spark, args.graph)
    plain = steps.where(~F.col("path").contains("#")).select("path").distinct()
    references = readers.found_references(readers.reference_names(spark, args.references), steps) if args.references else plain
    places = walks.on_reference(nodes, walks.step_offsets(steps.join(nodes.select("node", "len"), "node")), references)
    rows, rejected = nets.site_table(nodes.select("node", "len"), readers.gfa_links(spark, args.graph), readers.site_bounds(spark, args.bounds), places, s.cycle, s.budget, s.max_children)
    sinks.write_table(rows.orderBy("chr", "start", "site"), "sites", args.output)
    sinks.write_table(rejected.orderBy("site"), "rejected", args.output)
    table = readers.sites(spark, f"{args.output}/{sinks.FILES['sites']}")
    if table.isEmpty():
        raise ValueError("no site has two walks and a place on a reference path; -r names reference paths")
    for r in table.groupBy("chr").agg(F.count("*").alias("n"), F.sum(F.size("paths")).alias("k")).orderBy("chr").collect():
        print(f"{r['chr']}: {r['n']} sites, {r['k']} paths")
    return table


def run_vcf(spark: SparkSession, args: argparse.Namespace) -> None:
    s = pipelines.Settings(min_individuals=args.min_individuals, min_haplotypes=args.min_haplotypes, maf=args.maf, window=args.window, table_threshold=args.table_threshold, max_children=args.max_children, cycle=args.cycle, budget=args.budget)
    for name in (args.sites, args.vcf, args.binary, args.quantitative, args.expression, args.genes, args.covariates, args.graph, args.bounds, args.references, args.kinship):
        if name:
            readers.present(spark, name)
    if args.kinship:
        readers.kinship(spark, args.kinship).count()
    table = graph_sites(spark, args, s) if args.graph else readers.sites(spark, args.sites)
    if not args.vcf:
        return
    ensure_checkpoints(spark)
    samples = readers.vcf_samples(spark, args.vcf)
    paths = readers.site_paths(table)
    bits = genotype.bitmap_presence(paths, readers.known_chromosomes(readers.vcf_alleles(spark, args.vcf), table), samples).checkpoint()
    found = genotype.haplotypes(bits).join(samples, F.floor(F.col("hap") / 2) == F.col("sample_idx")).drop("sample_idx")
    place = table.select("chr", "start", "end", "site", "types", "depth")
    cov = samples.select("sample", F.array().cast("array<double>").alias("cov"))
    if args.covariates:
        cov = readers.matched(samples.select("sample"), readers.covariates(spark, args.covariates, args.covariate_names.split(",")), "covariates")
    if args.binary:
        traits = readers.matched(samples.select("sample"), readers.binary_phenotypes(spark, args.binary), "phenotype")
        if args.covariates:
            kind, out = "binary_covariates", pipelines.binary_covariates(found, traits.select("sample", F.col("is_case").cast("double").alias("pheno")).join(cov, "sample"), s)
        else:
            kind, out = "binary", pipelines.binary_bitmap(bits, genotype.masks(samples.join(traits, "sample")), s)
    elif args.quantitative:
        traits = readers.matched(samples.select("sample"), readers.quantitative_phenotypes(spark, args.quantitative), "phenotype")
        kind, out = "quantitative", pipelines.quantitative_bitmap(bits, samples.join(traits, "sample").join(cov, "sample").select("sample_idx", "pheno", "cov"), s)
    else:
        kind = "eqtl"
        genes = readers.genes(spark, args.genes)
        expression = readers.positioned(readers.expression(spark, args.expression), genes).select("gene", "sample", "expr")
        out = pipelines.eqtl(found, place.select("chr", "site", "start", "end"), genes, expression, cov, s)
    if kind != "binary":
        out = out.join(pipelines.allele_paths(paths, bits), "site")
    result, counts = pipelines.counted(place, out)
    print(f"{'pairs' if kind == 'eqtl' else 'sites'}: {counts['tested']} tested; {counts['without']} sites without a test")
    sinks.write_table(result.orderBy("chr", "start", "site"), kind, args.output)
    if args.gaf:
        sinks.write_gaf_paths(result, readers.gfa(spark, args.graph)[0], args.gaf)
    if s.table_threshold is not None:
        p = F.least("p_fisher", "p_chi2") if kind == "binary" else F.col("p")
        near = result.where(P.significant(p, s.table_threshold)).select("site").distinct()
        sinks.write_wide_tables(pipelines.regression_rows(found, near, reduced=kind != "binary"), args.output)


def run_graph(spark: SparkSession, args: argparse.Namespace) -> None:
    ensure_checkpoints(spark)
    for name in (args.graph, args.sites, args.tree, args.binary, args.references):
        if name:
            readers.present(spark, name)
    nodes, _, steps = readers.gfa(spark, args.graph)
    if args.sites:
        table = readers.sites(spark, args.sites)
        site_nodes, bounds = pipelines.site_nodes(table)
        alone = table.select("site", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("long").alias("min_len"), F.lit(None).cast("long").alias("max_len"), F.lit(False).alias("is_regular"))
        tree = (readers.site_tree(spark, args.tree) if args.tree else alone).join(table.select("site", "depth"), "site", "left")
    else:
        site_nodes, bounds, tree = pipelines.net_sites(nets.net(nodes.select("node", "len"), readers.gfa_links(spark, args.graph), readers.site_bounds(spark, args.tree)))
    tree = tree.withColumn("eligible", F.coalesce("max_len", F.lit(args.allele_size_limit)) >= args.allele_size_limit).checkpoint()
    samples = readers.binary_phenotypes(spark, args.binary)
    visits = pipelines.graph_visits(steps, site_nodes, bounds, tree).checkpoint()
    wanted = F.col("sample") == args.reference_sample if args.reference_sample else ~F.col("path").contains("#")
    references = readers.found_references(readers.reference_names(spark, args.references), steps) if args.references else steps.where(wanted).select("path").distinct()
    ranges, places = pipelines.graph_places(steps, nodes, bounds, tree, references)
    if args.test == "exact":
        levels = walks.descend(tree, lambda level: pipelines.graph(visits.join(level.select("site"), "site", "left_semi"), samples, exact=True))
        hits = levels[0]
        for level in levels[1:]:
            hits = hits.unionByName(level)
        out = hits.select("site").distinct().select("site", F.lit(None).cast("double").alias("p_fisher"), F.lit(None).cast("double").alias("p_chi2"), F.lit(None).cast("string").alias("group_paths"))
    else:
        out = pipelines.graph(visits.join(walks.reached(tree), "site", "left_semi"), samples, exact=False).select("site", "p_fisher", "p_chi2", "group_paths")
    if args.output_format == "tsv":
        lengths = tree.select("site", P.site_length_text(F.col("min_len"), F.col("max_len")).alias("types"))
        place = places.select("site", F.col("path").alias("chr"), "start", "end")
        rows = out.join(lengths, "site").join(place, "site", "left").join(tree.select("site", "depth"), "site")
        sinks.write_table(rows.orderBy("chr", "start", "site"), "graph", args.output)
        return
    chosen = walks.partitions(walks.signatures(visits.join(out.select("site"), "site", "left_semi").join(samples.select("sample"), "sample", "left_semi")))
    chosen = chosen.select("site", F.get("samples", F.lit(0)).alias("sample")).distinct()
    shown = ranges.withColumn("sample", P.sample_of_path(F.col("path"))["sample"]).join(chosen, ["site", "sample"], "left_semi").drop("sample")
    letters = walks.sequences(shown.select("site", "path", "from_rank", "to_rank"), steps, nodes)
    spans = places.select("site", F.concat("path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string")).alias("reference"))
    sinks.fasta(shown.join(letters, ["site", "path", "from_rank", "to_rank"]).join(spans, "site", "left")).write.mode("overwrite").text(f"{args.output}/{sinks.FILES['fasta']}")


def run_correct(spark: SparkSession, args: argparse.Namespace) -> None:
    rows = spark.read.csv(args.table, sep="\t", header=True)

    def named(column: str) -> str:
        if column in rows.columns:
            return column
        if not column.isdigit() or not 0 < int(column) <= len(rows.columns):
            raise ValueError(f"{args.table} has no column {column}")
        return rows.columns[int(column) - 1]

    p, to = F.col(f"`{named(args.p_column)}`").try_cast("double"), named(args.adjusted_column) if args.adjusted_column else "P_ADJUSTED"
    adjusted = stats.bh_adjusted(rows.withColumn("_value", p), "_value").drop("_value").withColumn(to, F.col("p_adjusted")).select(*dict.fromkeys([*rows.columns, to])).checkpoint()
    adjusted.write.mode("overwrite").csv(args.output, sep="\t", header=True)
    adjusted.where(F.col(f"`{to}`") < 1e-5).write.mode("overwrite").csv(sinks.with_suffix(args.output, "_top"), sep="\t", header=True)


def main(argv: list[str] | None = None) -> None:
    args = checked(parser().parse_args(argv))
    if args.command == "version":
        print("0.1.0")
        return
    spark = SparkSession.builder.appName("bubblestat").getOrCreate()
    {"vcf": run_vcf, "graph": run_graph, "correct": run_correct}[args.command](spark, args)


if __name__ == "__main__":
    main()
