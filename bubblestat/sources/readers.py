"""Text inputs as DataFrames. Headers and codes are checked before anything is computed from them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import blocks

#: The headers that inputs must have.
SITE_HEADER = ["CHR", "START_POS", "END_POS", "SNARL_HANDLEGRAPH", "SNARL", "PATHS", "TYPE", "REF", "DEPTH"]
PHENOTYPE_HEADER = ["FID", "IID", "PHENO"]
GENE_HEADER = ["gene_name", "chr", "start", "end"]
#: Header of the table of nested sites.
TREE_HEADER = ["SNARL", "PARENT", "MIN_LEN", "MAX_LEN", "REGULAR"]
#: Header of the table of sites' bounds.
BOUNDS_HEADER = ["START", "START_REV", "END", "END_REV"]


def _header(spark: SparkSession, path: str) -> str:
    first = spark.read.text(path).limit(1).collect()
    if not first or not first[0][0].strip():
        raise ValueError(f"{path} is empty")
    return first[0][0]


def _check(found: list[str], wanted: list[str], path: str) -> None:
    if found[: len(wanted)] != wanted:
        raise ValueError(f"{path}: header {found} where {wanted} is expected")


def _must(value: Column, good: Column, kind: str, what: str) -> Column:
    return F.when(good, value).otherwise(F.raise_error(F.concat(F.lit(f"{what}: "), F.coalesce(value.cast("string"), F.lit("nothing")))).cast(kind))


def present(spark: SparkSession, path: str) -> None:
    """Raises if a file isn't there or holds nothing."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(place):
        raise ValueError(f"{path} is missing")
    if files.getContentSummary(place).getLength() == 0:
        raise ValueError(f"{path} is empty")


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) lines; block-compressed files are read in ranges of their blocks, other gzip in one task each."""
    return blocks.read(spark, path) if path.endswith((".gz", ".bgz")) and blocks.is_blocked(path) else spark.read.text(path)


def vcf_lines(spark: SparkSession, path: str) -> DataFrame:
    """Records of a VCF; a gzip file that can't be split is dealt out anew after the scan."""
    lines = text_lines(spark, path).where(~F.col("value").startswith("#"))
    return lines.repartition(spark.sparkContext.defaultParallelism) if path.endswith((".gz", ".bgz")) and not blocks.is_blocked(path) else lines


def vcf_samples(spark: SparkSession, path: str) -> DataFrame:
    """(sample_idx, sample) in the order of the header's columns."""
    head = text_lines(spark, path).where(F.col("value").startswith("#CHROM")).limit(1).collect()
    if not head:
        raise ValueError(f"{path}: no header line")
    names = head[0][0].rstrip("\n").split("\t")[9:]
    return spark.createDataFrame(list(enumerate(names)), "sample_idx long, sample string")


def _records(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, at: paths of the alleles, gts: a text for each sample) of records at the outermost level, which are told before any genotype is cut out."""
    f = F.split("value", "\t")
    lv = F.regexp_extract(f[7], r"(?:^|;)LV=([0-9]+)", 1)
    rows = vcf_lines(spark, path).where((lv == "") | (lv == "0"))
    at = F.regexp_extract(f[7], r"(?:^|;)AT=([^;\t]*)", 1)
    return rows.select(f[0].alias("chr"), f[1].cast("long").alias("pos"), F.split(_must(at, at != "", "string", "record without AT"), ",").alias("at"), F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))).alias("gts"))


def vcf_calls(spark: SparkSession, path: str) -> DataFrame:
    """(chr, pos, sample_idx, hap, allele, path) of called alleles at the outermost level.

    Records whose LV is not 0 go before any genotype is cut out. hap is 2 x sample + 0 or 1; a missing allele has no row. AT holds a path for
    each allele, the reference first; a record without AT, or a genotype that isn't diploid, raises."""
    one = _records(spark, path).select("chr", "pos", "at", F.posexplode("gts").alias("sample_idx", "gt"))
    alleles = F.split(F.split_part(F.col("gt"), F.lit(":"), F.lit(1)), r"[/|]")
    two = one.select("chr", "pos", "at", F.col("sample_idx").cast("long").alias("sample_idx"), F.when(F.size(alleles) == 2, alleles).otherwise(F.raise_error(F.concat(F.lit("not diploid: "), "gt")).cast("array<string>")).alias("alleles"))
    each = two.select("chr", "pos", "at", "sample_idx", F.posexplode("alleles").alias("k", "a")).where("a != '.'")
    return each.select("chr", "pos", "sample_idx", (2 * F.col("sample_idx") + F.col("k")).alias("hap"), F.col("a").cast("int").alias("allele"), F.get("at", F.col("a").cast("int")).alias("path"))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out: tuple[list, ...] = ([], [], [], [])
        for chr_, paths, gts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            pairs = [re.split(r"[/|]", g.partition(":")[0]) for g in gts]
            odd = next((g for g, p in zip(gts, pairs, strict=True) if len(p) != 2), None)
            if odd is not None:
                raise ValueError(f"not diploid: {odd}")
            alleles = np.array([-1 if a == "." else int(a) for p in pairs for a in p], np.int64)
            padded = np.full(-(-len(alleles) // 64) * 64, -1, np.int64)
            padded[: len(alleles)] = alleles
            for a in np.unique(alleles[alleles >= 0]):
                if a < len(paths):
                    words = np.packbits(padded == a, bitorder="little").view("<i8")
                    on = np.flatnonzero(words)
                    out[0].extend([chr_] * len(on))
                    out[1].extend([paths[a]] * len(on))
                    out[2].extend(on.tolist())
                    out[3].extend(words[on].tolist())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["chr", "path", "word", "bits"])


def vcf_alleles(spark: SparkSession, path: str) -> DataFrame:
    """(chr, path, word, bits): the haplotypes of vcf_calls(), 64 to a row, packed as records are read; no row is made for a call."""
    return _records(spark, path).select("chr", "at", "gts").mapInArrow(_packed, "chr string, path string, word long, bits long")


def known_chromosomes(calls: DataFrame, sites: DataFrame) -> DataFrame:
    """Calls on chromosomes that have sites."""
    return calls.join(sites.select("chr").distinct(), "chr", "left_semi")


def sites(spark: SparkSession, path: str) -> DataFrame:
    """(chr, start, end, handle, site, paths array, types array, is_ref, depth) of a site table."""
    _check(_header(spark, path).split("\t"), SITE_HEADER, path)
    schema = "CHR string, START_POS long, END_POS long, SNARL_HANDLEGRAPH long, SNARL string, PATHS string, TYPE string, REF int, DEPTH int"
    rows = spark.read.csv(path, sep="\t", header=True, schema=schema, mode="FAILFAST")
    return rows.select(F.col("CHR").alias("chr"), F.col("START_POS").alias("start"), F.col("END_POS").alias("end"), F.col("SNARL_HANDLEGRAPH").alias("handle"), F.col("SNARL").alias("site"), F.split("PATHS", ",").alias("paths"), F.split("TYPE", ",").alias("types"), (F.col("REF") == 1).alias("is_ref"), F.col("DEPTH").alias("depth"))


def site_tree(spark: SparkSession, path: str) -> DataFrame:
    """(site, parent, min_len, max_len, is_regular) of a table of nested sites; no parent at the top, no lengths where none are known."""
    _check(_header(spark, path).split("\t"), TREE_HEADER, path)
    rows = spark.read.csv(path, sep="\t", header=True, schema="SNARL string, PARENT string, MIN_LEN long, MAX_LEN long, REGULAR int", nullValue="NA", mode="FAILFAST")
    return rows.select(F.col("SNARL").alias("site"), F.col("PARENT").alias("parent"), F.col("MIN_LEN").alias("min_len"), F.col("MAX_LEN").alias("max_len"), F.coalesce(F.col("REGULAR") == 1, F.lit(False)).alias("is_regular"))


def site_bounds(spark: SparkSession, path: str) -> DataFrame:
    """(start, start_rev, end, end_rev) of the sites of a graph: their boundary nodes, and whether they are walked backwards, into and out of the site.

    A table with BOUNDS_HEADER, or, where the name ends with .json or .jsonl, an object a line that has `start` and `end`, each with node_id and, if so, backward."""
    if path.endswith((".json", ".jsonl")):
        end = "struct<node_id: string, backward: boolean>"
        rows = spark.read.schema(f"start {end}, `end` {end}").json(path, mode="FAILFAST")
        node = lambda c: _must(F.col(f"{c}.node_id").try_cast("long"), F.col(f"{c}.node_id").try_cast("long").isNotNull(), "long", "site without a bound")
        back = lambda c: F.coalesce(F.col(f"{c}.backward"), F.lit(False))
        return rows.select(node("start").alias("start"), back("start").alias("start_rev"), node("end").alias("end"), back("end").alias("end_rev"))
    _check(_header(spark, path).split("\t"), BOUNDS_HEADER, path)
    rows = spark.read.csv(path, sep="\t", header=True, schema="START long, START_REV int, END long, END_REV int", mode="FAILFAST")
    return rows.select(F.col("START").alias("start"), (F.col("START_REV") == 1).alias("start_rev"), F.col("END").alias("end"), (F.col("END_REV") == 1).alias("end_rev"))


def site_paths(table: DataFrame) -> DataFrame:
    """(chr, site, path_idx, path) of sites()."""
    return table.select("chr", "site", F.posexplode("paths").alias("path_idx", "path"))


def _phenotypes(spark: SparkSession, path: str) -> DataFrame:
    _check(_header(spark, path).split(), PHENOTYPE_HEADER, path)
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(~F.col("value").startswith("FID") & (F.trim("value") != ""))
    return rows.select(_must(F.get(f, F.lit(1)), F.size(f) >= 3, "string", "line of fewer than three fields").alias("sample"), F.get(f, F.lit(2)).alias("v"))


def binary_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """(sample, is_case): code 1 is a control, 2 a case; any other raises."""
    v = F.col("v").try_cast("int")
    return _phenotypes(spark, path).select("sample", (_must(v, v.isin(1, 2), "int", "phenotype is neither 1 nor 2") == 2).alias("is_case"))


def quantitative_phenotypes(spark: SparkSession, path: str) -> DataFrame:
    """(sample, pheno); what is no number raises."""
    v = F.col("v").try_cast("double")
    return _phenotypes(spark, path).select("sample", _must(v, v.isNotNull(), "double", "phenotype is no number").alias("pheno"))


def covariates(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(sample, cov array) of the named columns, found by name; IID names the sample."""
    rows = spark.read.csv(path, sep="\t", header=True)
    missing = [c for c in ["IID", *names] if c not in rows.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    value = lambda c: _must(F.col(c).try_cast("double"), F.col(c).try_cast("double").isNotNull(), "double", f"covariate {c} is no number")
    return rows.select(F.col("IID").alias("sample"), F.array(*[value(c) for c in names]).alias("cov"))


def expression(spark: SparkSession, path: str) -> DataFrame:
    """(gene, sample, expr), a row for each cell of the matrix; sample names are its header."""
    rows = spark.read.csv(path, sep="\t", header=True)
    gene, names = rows.columns[0], rows.columns[1:]
    long = rows.unpivot([gene], [F.col(f"`{c}`") for c in names], "sample", "v")
    v = F.col("v").try_cast("double")
    return long.select(F.col(gene).alias("gene"), "sample", _must(v, v.isNotNull(), "double", "expression is no number").alias("expr"))


def genes(spark: SparkSession, path: str) -> DataFrame:
    """(gene, chr, g_start, g_end); of rows that repeat a gene the last in the file counts."""
    _check(_header(spark, path).split("\t"), GENE_HEADER, path)
    rows = spark.read.csv(path, sep="\t", header=True, schema="gene_name string, chr string, start long, end long")
    last = rows.withColumn("_i", F.monotonically_increasing_id()).groupBy("gene_name").agg(F.max(F.struct("_i", "chr", "start", "end")).alias("r"))
    return last.select(F.col("gene_name").alias("gene"), "r.chr", F.col("r.start").alias("g_start"), F.col("r.end").alias("g_end"))


def reference_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("path")).where("path != ''").distinct()


def kinship(spark: SparkSession, path: str) -> DataFrame:
    """(id, row array) of a square matrix whose first header cell is empty or a label."""
    rows = spark.read.csv(path, sep="\t", header=True)
    return rows.select(F.col(f"`{rows.columns[0]}`").alias("id"), F.array(*[F.col(f"`{c}`").cast("double") for c in rows.columns[1:]]).alias("row"))


def matched(samples: DataFrame, table: DataFrame, what: str) -> DataFrame:
    """table joined to samples by name; a sample without a row raises with its name."""
    lost = [r[0] for r in samples.join(table, "sample", "left_anti").select("sample").limit(5).collect()]
    if lost:
        raise ValueError(f"no {what} for {', '.join(lost)}")
    return samples.join(table, "sample")


def positioned(expression: DataFrame, genes: DataFrame) -> DataFrame:
    """expression joined to genes by name; a gene without a position raises with its name."""
    lost = [r[0] for r in expression.select("gene").distinct().join(genes, "gene", "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"no position for {', '.join(map(str, lost))}")
    return expression.join(genes, "gene")


def found_references(references: DataFrame, steps: DataFrame) -> DataFrame:
    """references, once each; a reference that no path of the graph is named by raises."""
    lost = [r[0] for r in references.select("path").distinct().join(steps, "path", "left_anti").limit(5).collect()]
    if lost:
        raise ValueError(f"not in the graph: {', '.join(map(str, lost))}")
    return references.select("path").distinct()


def gfa(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes (node, seq, len), edges (a, a_rev, b, b_rev) and steps (path, sample, hap, rank, node, rev) of S, L, P and W lines."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).select(F.substring("value", 1, 1).alias("kind"), f.alias("f"))
    at = lambda i: F.get("f", F.lit(i))
    nodes = lines.where("kind = 'S'").select(at(1).cast("long").alias("node"), at(2).alias("seq"), F.length(at(2)).cast("long").alias("len"))
    edges = lines.where("kind = 'L'").select(at(1).cast("long").alias("a"), (at(2) == "-").alias("a_rev"), at(3).cast("long").alias("b"), (at(4) == "-").alias("b_rev"))
    p = lines.where("kind = 'P'").select(at(1).alias("path"), F.split(at(2), ",").alias("s"))
    p = p.select("path", F.posexplode("s").alias("rank", "t")).select("path", "rank", F.expr("cast(left(t, length(t) - 1) as long)").alias("node"), F.col("t").endswith("-").alias("rev"))
    w = lines.where("kind = 'W'").select(F.concat_ws("#", at(1), at(2), at(3)).alias("path"), F.regexp_extract_all(at(6), F.lit("([<>][0-9]+)"), F.lit(1)).alias("s"))
    w = w.select("path", F.posexplode("s").alias("rank", "t")).select("path", "rank", F.substring("t", 2, 20).cast("long").alias("node"), (F.substring("t", 1, 1) == "<").alias("rev"))
    parts = F.split("path", "#")
    both = p.unionByName(w).select("path", F.get(parts, F.lit(0)).alias("sample"), F.coalesce(F.get(parts, F.lit(1)).try_cast("int"), F.lit(0)).alias("hap"), F.col("rank").cast("long").alias("rank"), "node", "rev")
    return nodes, edges, both


def gfa_links(spark: SparkSession, path: str) -> DataFrame:
    """(a, a_rev, b, b_rev, ord) of L lines; ord grows with their place in the file."""
    f = F.split("value", "\t")
    lines = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where(F.col("value").startswith("L\t"))
    return lines.select(f[1].cast("long").alias("a"), (f[2] == "-").alias("a_rev"), f[3].cast("long").alias("b"), (f[4] == "-").alias("b_rev"), "ord")


def first_on_path(rows: DataFrame, path: str, rank: str) -> DataFrame:
    """The first row of each path by rank."""
    return rows.withColumn("_k", F.row_number().over(W.partitionBy(path).orderBy(rank))).where("_k = 1").drop("_k")


READERS = {".vcf": vcf_calls, ".vcf.gz": vcf_calls, ".gfa": gfa, ".tsv": sites}


def reader_of(path: str):
    """The reader for a path's ending."""
    for ending in sorted(READERS, key=len, reverse=True):
        if path.endswith(ending):
            return READERS[ending]
    raise ValueError(f"no reader for {path}; convert binary graphs to GFA first")
