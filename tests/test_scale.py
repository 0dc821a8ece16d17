"""Registered queries on tables whose keys or groups are larger than those of the small tables, against their SQL."""

import datetime
import random
import time

import duckdb
import pytest

import __spark_entry__ as entry
from bubblestat.operators import stats

_DAY = datetime.datetime(2000, 1, 1)
SCHEMAS = {
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string",
    "customer": "c_custkey long, c_nationkey int, c_acctbal double",
    "supplier": "s_suppkey long, s_nationkey int",
    "part": "p_partkey long, p_size int",
}


def _line(order, part, supplier, number, quantity=1.0, flag="N", status="O"):
    return (order, part, supplier, number, quantity, flag, status)


def _order(order, customer):
    return (order, customer, "O", 1.0, _DAY, "1-URGENT")


def _same_as_sql(spark, folder, name, **tables):
    """Rows of a query over tables, which equal those of its SQL."""
    db = duckdb.connect()
    for t, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[t]).write.parquet(f"{folder}/{t}.parquet")
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = db.execute(entry.oracle_sql()[name]).fetchall()
    got = [tuple(r) for r in entry.queries()[name](spark, str(folder)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def test_allele_sequences_of_large_part_numbers(spark, tmp_path):
    """A first line of a part beyond a million isn't taken, nor is a second line put out of the SQL's order; long texts aren't wrapped."""
    rows = [_line(1, 1_100_000, 3, 1, flag="A"), _line(1, 5, 3, 2, flag="R"), _line(2, 1_100_000, 3, 1), _line(3, 1_200_000, 1, 2, flag="R"), _line(3, 2, 1, 3, flag="A")]
    rows += [_line(4, k, 1, 2 + k % 5) for k in range(60)]
    got = dict(_same_as_sql(spark, tmp_path, "allele_sequences", lineitem=rows))
    assert got == {1: "RO", 3: "AORO", 4: "NO" * 60}


def test_chi2_of_many_paths(spark):
    """Time in proportion to a site's paths: with sums made again for each path, 40,000 of them took minutes."""
    v = spark.range(40_000).selectExpr("id % 3 AS a", "id % 5 + 1 AS b").agg({"a": "collect_list", "b": "collect_list"}).toDF("g0", "g1").selectExpr("'s' AS site", "array('p') AS paths", "g0", "g1")
    start = time.time()
    row = stats.tested(v).select("g0", "g1", "chi2", "df").first()
    assert time.time() - start < 30
    t0, t1 = sum(row["g0"]), sum(row["g1"])
    want = sum((x - (a + b) * t / (t0 + t1)) ** 2 / ((a + b) * t / (t0 + t1)) for a, b in zip(row["g0"], row["g1"], strict=True) for x, t in ((a, t0), (b, t1)))
    assert row["df"] == 39_999 and row["chi2"] == pytest.approx(want)


def test_paths_of_one_set_of_edges(spark, tmp_path):
    """Against SQL: shared sets, sets that meet in one edge, an edge nobody carries, wildcards in part and alone."""
    lines = [_line(o, p, s, n) for o, (p, s, n) in enumerate([(1, 1, 2), (1, 1, 3), (41, 11, 2), (5, 5, 1), (10, 10, 1), (40, 3, 4), (7, 7, 7), (1, 1, 2)])]
    tables = {"lineitem": lines, "orders": [_order(o, o % 3) for o in range(8)], "part": [(p, z) for p in (1, 41, 81, 5, 7, 40, 10, 20, 121, 33) for z in (1, 2)]}
    for i, name in enumerate(("path_presence", "path_presence_bitmap", "vacuous_path")):
        assert _same_as_sql(spark, tmp_path / str(i), name, **{t: list(dict.fromkeys(r)) if t != "part" else r[::2] for t, r in tables.items()})


@pytest.mark.parametrize(("name", "supplier"), [("path_presence", 1), ("path_presence_bitmap", 1), ("vacuous_path", 0)])
def test_many_paths_with_many_haplotypes(spark, tmp_path, name, supplier):
    """100,000 paths of one set with 20,000 haplotypes: what is shared is worked out once. Two billion rows, one for each path and haplotype, took too long."""
    n, parts = 20_000, 100_000
    spark.range(n).selectExpr("id AS l_orderkey", f"{supplier}L AS l_partkey", f"{supplier}L AS l_suppkey", "2 AS l_linenumber").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.range(n).selectExpr("id AS o_orderkey", "id AS o_custkey").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(parts).selectExpr(f"id * 40 + {supplier} AS p_partkey", "1 AS p_size").write.parquet(f"{tmp_path}/part.parquet")
    start = time.time()
    rows = entry.queries()[name](spark, str(tmp_path)).selectExpr("count(*)", "min(n_haps)", "max(n_haps)").first()
    assert tuple(rows) == (parts, n, n) and time.time() - start < 60


def test_eqtl_deals_no_row_for_each_site_of_a_gene(spark, tmp_path):
    """Rows equal the SQL's, and what is made for each gene, site and sample stays in its task."""
    rng = random.Random(5)
    lines = [_line(o, rng.randrange(200), rng.randrange(12), rng.randrange(1, 8), float(rng.randrange(1, 50)), rng.choice("NRA"), rng.choice("OF")) for o in range(400) for _ in range(4)]
    tables = {"lineitem": lines, "orders": [_order(o, o % 40) for o in range(400)], "customer": [(c, c % 5, c * 100.0) for c in range(40)], "part": [(p, p % 50) for p in range(200)], "supplier": [(s, 0) for s in range(12)]}
    assert len(_same_as_sql(spark, tmp_path, "eqtl_assoc", **tables)) > 50
    assert "hashpartitioning(site" not in entry.queries()["eqtl_assoc"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
