"""Queries in which many haplotypes share a walk: orders walk their customer's nation, line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import walks
from . import mapping as M
from . import pipelines
from .queries import _r, query


def _visits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, hap, sample, child, direction, offset, next): an order's lines in its customer's nation; a line leads to its return flag, lines of one number in the order of their parts."""
    o = M.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample"))
    rows = M.table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(M.samples(spark, sf_dir).select("sample", "nation"), "sample")
    return rows.select(F.col("nation").alias("site"), F.col("l_orderkey").alias("hap"), "sample", F.col("l_linenumber").alias("child"), (F.col("l_linestatus") == "O").cast("int").alias("direction"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_returnflag").alias("offset"), F.col("l_returnflag").alias("next"))


_SQL = """WITH cohort AS (SELECT c_custkey AS sample, c_acctbal > 4500 AS is_case, c_nationkey AS site FROM customer),
one AS (SELECT c.site, l_orderkey AS hap, sample, l_linenumber || '/' || CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END || '/' || string_agg(l_returnflag, '>' ORDER BY l_partkey, l_suppkey, l_quantity, l_returnflag) AS one
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN cohort c ON c.sample = o_custkey GROUP BY c.site, l_orderkey, sample, l_linenumber, l_linestatus),
walks AS (SELECT site, hap, sample, string_agg(one, ' ' ORDER BY one) AS walk FROM one GROUP BY site, hap, sample),
sets AS (SELECT site, walk, count(DISTINCT sample) AS n, min(sample) AS first, count(*) AS haps FROM walks GROUP BY site, walk),
counts AS (SELECT w.site, walk, count(DISTINCT sample) FILTER (WHERE is_case) AS n0, count(DISTINCT sample) FILTER (WHERE NOT is_case) AS n1 FROM walks w JOIN cohort USING (sample) GROUP BY w.site, walk)
"""


@query(_SQL + "SELECT site, walk, count(*) AS haps, count(DISTINCT sample) AS n_samples, sum(hap)::BIGINT AS hap_sum FROM walks GROUP BY site, walk")
def shared_walks(spark, sf_dir):
    return walks.signatures(_visits(spark, sf_dir)).groupBy("site", "walk").agg(F.count("*").alias("haps"), F.countDistinct("sample").alias("n_samples"), F.sum("hap").alias("hap_sum"))


@query(_SQL + "SELECT site, walk, row_number() OVER (PARTITION BY site ORDER BY first, walk) - 1 AS part, n, first FROM sets")
def shared_walk_partitions(spark, sf_dir):
    p = walks.partitions(walks.signatures(_visits(spark, sf_dir)))
    return p.select("site", "walk", F.col("part").cast("long").alias("part"), F.size("samples").cast("long").alias("n"), F.get("samples", F.lit(0)).alias("first"))


@query(
    _SQL
    + """, t AS (SELECT *, sum(n0) OVER (PARTITION BY site) AS t0, sum(n1) OVER (PARTITION BY site) AS t1, count(*) OVER (PARTITION BY site) AS k FROM counts)
SELECT site, any_value(k) - 1 AS df, md5(string_agg(n0 || ':' || n1, ',' ORDER BY walk)) AS group_paths_md5,
       round(CASE WHEN min(t0) > 0 AND min(t1) > 0 THEN sum(power(n0 - (n0 + n1) * t0 / (t0 + t1), 2) / ((n0 + n1) * t0 / (t0 + t1)) + power(n1 - (n0 + n1) * t1 / (t0 + t1), 2) / ((n0 + n1) * t1 / (t0 + t1))) END, 6) AS chi2
FROM t GROUP BY site HAVING any_value(k) > 1"""
)
def shared_walk_assoc(spark, sf_dir):
    """Counts of customers by walk, cases first, and their test."""
    out = pipelines.graph(_visits(spark, sf_dir), M.samples(spark, sf_dir).select("sample", "is_case"), exact=False)
    return out.select("site", "df", F.md5("group_paths").alias("group_paths_md5"), _r("chi2").alias("chi2"))


@query(
    """WITH most AS (SELECT o_custkey AS sample, max(o_totalprice) AS top FROM orders GROUP BY 1), cohort AS (SELECT sample, top > 400000 AS is_case FROM most),
w AS (SELECT s AS site, CASE WHEN top > s * 50000 THEN 'above' ELSE 'below' END AS walk, sample FROM most, range(0, 12) r(s) UNION ALL SELECT 99, 'above', sample FROM cohort WHERE is_case),
t AS (SELECT count(*) FILTER (WHERE is_case) AS cases, count(*) FILTER (WHERE NOT is_case) AS controls FROM cohort),
c AS (SELECT site, walk, count(*) FILTER (WHERE is_case) AS n_case, count(*) FILTER (WHERE NOT is_case) AS n_control, count(*) OVER (PARTITION BY site) AS k FROM w JOIN cohort USING (sample) GROUP BY site, walk)
SELECT site, walk, CASE WHEN n_control = 0 THEN 'case' ELSE 'control' END AS which FROM c, t
WHERE k > 1 AND (n_control = 0 AND n_case = cases AND cases > 0 OR n_case = 0 AND n_control = controls AND controls > 0)"""
)
def exact_set_graph(spark, sf_dir):
    """Customers walk each of twelve price marks above or below; site 99 has cases only, on one walk, which separates nobody."""
    top = M.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("sample")).agg(F.max("o_totalprice").alias("top"))
    cohort = top.select("sample", (F.col("top") > 400000).alias("is_case"))
    marks = top.select(F.explode(F.sequence(F.lit(0), F.lit(11))).alias("site"), "sample", "top").select("site", "sample", F.when(F.col("top") > F.col("site") * 50000, "above").otherwise("below").alias("next"))
    rows = marks.unionByName(cohort.where("is_case").select(F.lit(99).alias("site"), "sample", F.lit("above").alias("next")))
    visits = rows.select("site", F.col("sample").alias("hap"), "sample", F.lit(1).alias("child"), F.lit(0).alias("direction"), F.lit(0).alias("offset"), "next")
    return pipelines.graph(visits, cohort, exact=True).select("site", F.regexp_replace("walk", "^1/0/", "").alias("walk"), "which")
