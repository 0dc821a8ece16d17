"""Results as the text files that other tools read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.special import fmt4, log10_fmt4

#: Columns of the four association tables, and their names here.
HEADERS = {
    "binary": "#CHR START_POS END_POS SNARL PATH_LENGTHS P_FISHER P_CHI2 GROUP_PATHS DEPTH",
    "binary_covariates": "#CHR START_POS END_POS SNARL PATH_LENGTHS P BETA SE ALLELE_PATHS DEPTH",
    "quantitative": "#CHR START_POS END_POS SNARL PATH_LENGTHS P RSQUARE BETA SE ALLELE_PATHS DEPTH",
    "eqtl": "#CHR START_POS END_POS SNARL PATH_LENGTHS GENE P RSQUARE BETA SE ALLELE_PATHS DEPTH",
    "sites": "CHR START_POS END_POS SNARL_HANDLEGRAPH SNARL PATHS TYPE REF DEPTH",
    "rejected": "SNARL REASON",
    "graph": "#CHR START_POS END_POS SNARL PATH_LENGTHS P_FISHER P_CHI2 GROUP_PATHS DEPTH",
}
COLUMNS = {"#CHR": "chr", "CHR": "chr", "START_POS": "start", "END_POS": "end", "SNARL": "site", "SNARL_HANDLEGRAPH": "handle", "PATH_LENGTHS": "types", "TYPE": "types", "PATHS": "paths", "REF": "is_ref", "P_FISHER": "p_fisher", "P_CHI2": "p_chi2", "RSQUARE": "r2"}
#: Names of result files by analysis.
FILES = {"binary": "binary_table_vcf.tsv", "binary_covariates": "binary_table_vcf.tsv", "quantitative": "quantitative_table_vcf.tsv", "eqtl": "eqtl_table_vcf.tsv", "graph": "binary_table_graph.tsv", "fasta": "binary_output.fasta", "sites": "snarl_analyse.tsv", "rejected": "snarl_not_analyse.tsv"}


def as_text(rows: DataFrame, kind: str) -> DataFrame:
    """rows with the table's header: numbers in four digits, NA where there is none, lists joined by commas. A p-value too small for a double is written from its logarithm, log10_ and its name, where rows have that."""
    out = []
    for name in HEADERS[kind].split():
        column = COLUMNS.get(name, name.lower())
        type_of = rows.schema[column].dataType.simpleString()
        value = F.col(column)
        text = fmt4(value) if type_of == "double" else F.array_join(value, ",") if type_of.startswith("array") else value.cast("int").cast("string") if type_of == "boolean" else value.cast("string")
        if f"log10_{column}" in rows.columns:
            text = F.when((value == 0) & F.col(f"log10_{column}").isNotNull(), log10_fmt4(f"log10_{column}")).otherwise(text)
        out.append(F.coalesce(text, F.lit("NA")).alias(name))
    return rows.select(*out)


def write_table(rows: DataFrame, kind: str, folder: str) -> None:
    """A folder of tab-separated files, one for each task, each with the header."""
    as_text(rows, kind).write.mode("overwrite").option("comment", "~").csv(f"{folder}/{FILES.get(kind, kind + '.tsv')}", sep="\t", header=True)


def fasta(sequences: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """Records of (site, reference, path, start, end, sequence); the site's bounds with a dash, its place on the reference, or a note that there is none, the path's own place, and letters, if any. With samples (sample) only their paths."""
    if samples is not None:
        sequences = sequences.withColumn("sample", P.sample_of_path(F.col("path"))["sample"]).join(samples.select("sample").distinct(), "sample", "left_semi")
    ref = F.coalesce("reference", F.lit("NOREF:?:?"))
    return sequences.select(F.concat(F.lit(">snarl:"), F.replace(F.col("site"), F.lit("_"), F.lit("-")), F.lit("|"), ref, F.lit("|"), "path", F.lit(":"), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.when(F.col("sequence") != "", F.concat(F.lit("\n"), "sequence")).otherwise("")).alias("value"))


def gaf_lines(paths: DataFrame) -> DataFrame:
    """The twelve columns and a cs tag of an alignment line for (name, path, length, share)."""
    n = F.col("length").cast("string")
    return paths.select(F.concat_ws("\t", "name", n, F.lit("0"), n, F.lit("+"), "path", n, F.lit("0"), n, n, n, F.round("share").cast("int").cast("string"), F.concat(F.lit("cs:Z::"), n)).alias("value"))


def gaf_pair(results: DataFrame, lengths: DataFrame, shares) -> tuple[DataFrame, DataFrame]:
    """Lines for controls and for cases of each path of a result (site, paths, g0, g1, p), joined to its length by key."""
    each = results.select("site", "p", F.explode(F.arrays_zip("paths", "g0", "g1")).alias("z")).select("site", "p", F.col("z.paths").alias("path"), F.col("z.g0").alias("g0"), F.col("z.g1").alias("g1"))
    shown = each.join(lengths, ["site", "path"]).withColumn("s", shares(F.col("p"), F.col("g0"), F.col("g1")))
    side = lambda which, tag: gaf_lines(shown.select(F.concat_ws("_", "site", F.lit(tag)).alias("name"), "path", "length", F.col(f"s.{which}").alias("share")))
    return side("first", "G0"), side("second", "G1")


def gaf_paths(results: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines `name path length share` for controls and for cases of each path of a result (site, paths, g0, g1, p_fisher, p_chi2). A path with a nested site shows as the paths before and behind it.

    The name holds the site, the group and its carriers, and both p-values, 1 where there is none; length counts letters of all nodes of the path."""
    z = F.explode(F.arrays_zip("paths", "g0", "g1")).alias("z")
    p = lambda c: F.format_string("%.6f", P.p_or_one(F.col(c)))
    each = results.select("site", "p_fisher", "p_chi2", z).select("site", P.p_or_one(F.col("p_fisher")).alias("p"), F.concat(F.lit("_F"), p("p_fisher"), F.lit("_C"), p("p_chi2")).alias("ps"), F.col("z.g0").alias("g0"), F.col("z.g1").alias("g1"), F.col("z.paths").alias("whole"), F.explode(P.pieces(F.col("z.paths"))).alias("path"))
    letters = each.select("path").distinct().select("path", F.explode(P.digits(F.col("path"))).alias("d")).select("path", F.col("d").cast("long").alias("node")).join(nodes.select("node", "len"), "node").groupBy("path").agg(F.sum("len").alias("length"))
    shown = each.join(letters, "path").withColumn("s", P.display_shares(F.col("p"), F.col("g0"), F.col("g1")))
    side = lambda g, tag, share: shown.select(F.concat_ws("\t", F.concat("site", F.lit(f"_{tag}_"), F.col(g).cast("string"), "ps"), "path", F.col("length").cast("string"), F.call_function("format_number", F.col(f"s.{share}"), F.lit("0.####"))).alias("value"))
    return side("g0", "G0", "first"), side("g1", "G1", "second")


def write_gaf_paths(results: DataFrame, nodes: DataFrame, name: str) -> None:
    """The two files of gaf_paths(), named with _0 and _1."""
    for lines, tag in zip(gaf_paths(results, nodes), ("_0", "_1"), strict=True):
        lines.write.mode("overwrite").text(with_suffix(name, tag))


def write_wide_tables(rows: DataFrame, folder: str) -> None:
    """A table for each site of (site, sample, path_idx, path, dosage): `sample_name` and a column for each path, in the order of the site's list, with 0 where a sample isn't on a path.

    All lines are made by joins and grouping; a site's header is its first line, so each site is one folder of text files whose first has the header. Writing again replaces all."""
    order = rows.select("site", "path_idx", "path").distinct().groupBy("site").agg(F.array_sort(F.collect_list(F.struct("path_idx", "path"))).alias("o"))
    cells = rows.groupBy("site", "sample").agg(F.map_from_entries(F.collect_list(F.struct("path_idx", "dosage"))).alias("m")).join(order, "site")
    value = lambda x: F.coalesce(F.element_at("m", x["path_idx"]), F.lit(0.0))
    number = lambda v: F.regexp_replace(F.call_function("format_number", v, F.lit("0.######")), "^-0$", "0")
    lines = cells.select("site", F.lit(1).alias("k"), "sample", F.concat_ws("\t", "sample", F.transform("o", lambda x: number(value(x)))).alias("value"))
    heads = order.select("site", F.lit(0).alias("k"), F.lit(None).cast("string").alias("sample"), F.concat_ws("\t", F.lit("sample_name"), "o.path").alias("value"))
    both = heads.unionByName(lines).repartition("site").sortWithinPartitions("site", "k", "sample")
    both.select("site", "value").write.mode("overwrite").partitionBy("site").text(f"{folder}/regression")


def write_regression_tables(rows: DataFrame, folder: str) -> None:
    """(site, sample, path, dosage) of significant sites, a folder for each site."""
    rows.write.mode("overwrite").partitionBy("site").csv(f"{folder}/regression", sep="\t", header=True)


def with_suffix(name: str, suffix: str) -> str:
    """The suffix before the last dot, or at the end."""
    stem, dot, ending = name.rpartition(".")
    return f"{stem}{suffix}.{ending}" if dot else name + suffix
