"""One reading of the order tables as a study: customers are samples, order lines are genotype calls."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, is_case, pheno, nation)"""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), (F.col("c_acctbal") > 4500).alias("is_case"), F.col("c_acctbal").alias("pheno"), F.col("c_nationkey").alias("nation"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, path, hap, sample), distinct: a haplotype may carry several paths of a site."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_returnflag", "l_linestatus").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    hap = (F.col("o_custkey") * 2 + F.col("l_linenumber") % 2).alias("hap")
    return rows.select((F.col("l_partkey") % 50).alias("site"), F.concat("l_returnflag", "l_linestatus").alias("path"), hap, F.col("o_custkey").alias("sample")).distinct()


def edge_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chr, hap, path) of walks `>part<supplier>line`, one for each order line."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select((F.col("l_partkey") % 5).alias("chr"), (F.col("o_custkey") * 2 + F.col("l_linenumber") % 2).alias("hap"), walk("l_partkey", "l_suppkey", "l_linenumber").alias("path"))


def walk(part: str, supplier: str, line: str):
    return F.concat(F.lit(">"), (F.col(part) % 40).cast("string"), F.lit("<"), (F.col(supplier) % 10).cast("string"), F.lit(">"), F.col(line).cast("string"))


def visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, sample, hap, walk): a user's events in order, as one walk of the site that the user falls in."""
    from pyspark.sql import Window as W

    e = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id")
    k = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.withColumn("k", k).select((F.col("user_id") % 3).alias("site"), F.col("user_id").alias("sample"), F.col("user_id").alias("hap"), F.col("event_type").alias("next"), F.col("k").alias("offset"))


def two_paths(spark: SparkSession, sf_dir: str, by_sample: bool = False) -> DataFrame:
    """Calls (site, path, hap, sample) of sites with two paths: an order line's status, or, by_sample, one path for each sample."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    path = F.when(F.col("o_custkey") % 3 == 0, "a").otherwise("b") if by_sample else F.col("l_linestatus")
    return rows.select((F.col("l_partkey") % 50).alias("site"), path.alias("path"), (F.col("o_custkey") * 2 + F.col("l_linenumber") % 2).alias("hap"), F.col("o_custkey").alias("sample")).distinct()


SQL = """
WITH samples AS (SELECT c_custkey AS sample, c_acctbal > 4500 AS is_case, c_acctbal AS pheno, c_nationkey AS nation FROM customer),
calls AS (
    SELECT DISTINCT l_partkey % 50 AS site, l_returnflag || l_linestatus AS path, o_custkey * 2 + l_linenumber % 2 AS hap, o_custkey AS sample
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
counted AS (
    SELECT site, path, count(*) FILTER (WHERE NOT is_case) AS n0, count(*) FILTER (WHERE is_case) AS n1
    FROM calls JOIN samples USING (sample) GROUP BY site, path
),
sited AS (SELECT *, sum(n0) OVER (PARTITION BY site) AS t0, sum(n1) OVER (PARTITION BY site) AS t1, count(*) OVER (PARTITION BY site) AS k FROM counted WHERE n0 + n1 > 0),
tested AS (
    SELECT site, string_agg(path, ',' ORDER BY path) AS paths, string_agg(n0 || ':' || n1, ',' ORDER BY path) AS group_paths, any_value(k) - 1 AS df,
           CASE WHEN min(t0) > 0 AND min(t1) > 0 THEN sum(power(n0 - (n0 + n1) * t0 / (t0 + t1), 2) / ((n0 + n1) * t0 / (t0 + t1)) + power(n1 - (n0 + n1) * t1 / (t0 + t1), 2) / ((n0 + n1) * t1 / (t0 + t1))) END AS chi2
    FROM sited GROUP BY site
    HAVING any_value(k) >= 2 AND sum(n0 + n1) // 2 >= 3 AND sum(n0 + n1) >= 5 AND count(*) FILTER (WHERE least(n0, n1) / (n0 + n1) > 0.05) >= 2
),
dosed AS (SELECT site, sample, path, count(*) AS n FROM calls GROUP BY site, sample, path),
dosage AS (SELECT *, n / sum(n) OVER (PARTITION BY site, sample) AS dosage FROM dosed),
tests AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey AS grp, (l_partkey * 37 + l_suppkey * 11 + l_linenumber * 7 + l_orderkey) % 9973 / 99730000.0 AS p, l_partkey % 50 AS site FROM lineitem),
edge_calls AS (
    SELECT l_partkey % 5 AS chr, o_custkey * 2 + l_linenumber % 2 AS hap, l_partkey % 40 AS a, l_suppkey % 10 AS b, l_linenumber AS c
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey
),
carried AS (
    SELECT chr, hap, '>' || a || '<' || b AS edge FROM edge_calls UNION SELECT chr, hap, '<' || b || '>' || c FROM edge_calls
)
"""
