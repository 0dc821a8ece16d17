"""Known values, and whole analyses against plain loops."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from bubblestat.functions import paths as P
from bubblestat.functions import special
from bubblestat.operators import decompose, evaluate, genotype, intervals, stats, tables, walks
from bubblestat.plans import cli, pipelines
from bubblestat.sources import readers, sinks


def sci(x):
    return special.number_text(x)


@pytest.mark.parametrize(
    "g0, g1, chi2, fisher",
    [
        ([10, 20], [20, 10], "9.8233e-03", "1.9383e-02"),
        ([30, 5], [2, 25], "9.5037e-10", "3.5379e-10"),
        ([10, 15, 5], [20, 10, 10], "9.6972e-02", None),
        ([5, 10, 15, 20], [20, 15, 10, 5], "1.6974e-04", None),
        ([10] * 5, [10] * 5, "1", None),
        ([1, 0], [0, 1], "0.1573", "1"),
        ([79, 18], [96, 23], "0.8857", "1"),
        ([122, 78], [27, 173], "8.8051e-23", "1.4799e-23"),
        ([0, 0], [3, 4], "NA", "NA"),
        ([0, 3], [0, 4], "NA", "NA"),
    ],
)
def test_tests_of_tables(spark, g0, g1, chi2, fisher):
    rows = spark.createDataFrame([(g0, g1)], "g0 array<long>, g1 array<long>")
    r = stats.tested(rows).first()
    assert sci(r["p_chi2"]) == chi2
    assert sci(r["p_fisher"]) == (fisher or "NA")


def test_number_text():
    assert [sci(x) for x in (1.234e-5, 0.12345, 1 / 3, 1.0, None, 0.0)] == ["1.2340e-05", "0.1235", "0.3333", "1", "NA", "0"]


def test_tails():
    assert special.chi2_sf(80, 1) == pytest.approx(math.erfc(math.sqrt(40)), rel=1e-10)
    assert special.t_two_sided(2.0, 1) == pytest.approx(1 - 2 / math.pi * math.atan(2.0), rel=1e-10)
    assert special.t_two_sided(1.5, 2) == pytest.approx(1 - 1.5 / math.sqrt(2 + 1.5**2), rel=1e-10)
    assert special.t_two_sided(np.inf, 5) == 1.0


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.002, 0.05]
    rows = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    got = {r["id"]: r["p_adjusted"] for r in stats.bh_adjusted(rows).collect()}
    assert [round(got[i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.01, 0.05]
    rng = random.Random(1)
    p = [None if rng.random() < 0.1 else round(rng.random(), 2) for _ in range(500)]
    q = [1.0 if x is None else x for x in p]
    want = [min(1.0, min(len(q) * y / sum(z <= y for z in q) for y in q if y >= x)) for x in q]
    rows = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    got = {r["id"]: r["p_adjusted"] for r in stats.bh_adjusted(rows, chunks=7).collect()}
    assert [got[i] for i in range(500)] == pytest.approx(want)


def test_holm(spark):
    p = [0.01, 0.04, 0.03, 0.005]
    rows = spark.createDataFrame([(i, "a", x) for i, x in enumerate(p)], "id long, k string, p double")
    got = {r["id"]: r["p_holm"] for r in stats.holm_adjusted(rows, "k").collect()}
    assert [got[i] for i in range(4)] == pytest.approx([0.03, 0.06, 0.06, 0.02])
    assert stats.holm(np.array(p)).tolist() == pytest.approx([0.03, 0.06, 0.06, 0.02])


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first()["x"]


def test_paths(spark):
    t = ">1<324<323<0<213>214<0<213"
    assert one(spark, P.edges(F.col("t")), t=t) == [">1<324", "<324<323", "<323<0", "<0<213", "<213>214", ">214<0", "<0<213"]
    assert one(spark, P.edges(F.col("t")), t=">7") == []
    assert one(spark, P.edges_of_list(F.col("t")), t=">1>2,<3<4") == [[">1>2"], ["<3<4"]]
    assert one(spark, P.flipped(F.col("t")), t=">1<2>0>3") == "<3>0>2<1"
    assert one(spark, P.mostly_forward(F.col("t")), t="<3<2<1") == ">1>2>3"
    assert one(spark, P.mostly_forward(F.col("t")), t="<3<2>1") == one(spark, P.flipped(F.col("t")), t="<3<2>1")
    assert one(spark, P.digits(F.col("t")), t="1>2>3") == ["1", "2", "3"]
    assert tuple(one(spark, P.site_ends(F.col("t")), t="12_7")) == (12, 7)
    assert tuple(one(spark, P.sample_of_path(F.col("t")), t="s1#2#chr1")) == ("s1", 2)
    with pytest.raises(Exception, match="not a site"):
        one(spark, P.site_ends(F.col("t")), t="12")
    for a, b, p in itertools.product((0, 5, 10, 15), (0, 5, 10), (1e-30, 0.01, 1.0)):
        s = one(spark, P.display_shares(F.lit(p), F.col("a"), F.col("b")), a=a, b=b)
        assert 0 <= s["first"] <= 60 and 0 <= s["second"] <= 60
        assert s["first"] + s["second"] == pytest.approx(60 if a + b else 0)


def test_division(spark):
    carried = spark.createDataFrame([("c", e, h) for e, h in [(">1>2", 0), (">2>3", 0), (">1>2", 2), (">2>3", 2), (">1>2", 1)]], "chr string, edge string, hap long")
    sites = spark.createDataFrame([("c", "s", 0, ">1>2>3"), ("c", "s", 1, ">1>0>3"), ("c", "s", 2, ">1>9")], "chr string, site string, path_idx int, path string")
    got = {(r["path_idx"], r["hap"]) for r in genotype.presence(sites, carried, carried).collect()}
    assert got == {(0, 0), (0, 2), (1, 0), (1, 1), (1, 2)}  # a path of wildcard edges alone asks nothing
    bits = genotype.bitmap_division(genotype.path_edges(sites), genotype.edge_bitmaps(carried)).collect()
    assert [(r["path_idx"], r["word"], r["bits"]) for r in bits] == [(0, 0, 0b101)]


def test_filters(spark):
    v = spark.createDataFrame([("a", [5, 5], [5, 5]), ("b", [1, 0], [0, 1]), ("c", [9, 9], [0, 0]), ("d", [9], [9])], "site string, g0 array<long>, g1 array<long>")
    assert {r["site"] for r in v.where(tables.passes_binary(F.col("g0"), F.col("g1"), 3, 5, 0.05)).collect()} == {"a"}
    d = [("a", s, p, x) for s in "stuv" for p, x in (("p", 0.5), ("q", 0.5))] + [("b", s, "p", 1.0) for s in "stuvwx"]
    d = spark.createDataFrame(d, "site string, sample string, path string, dosage double")
    assert {r["site"] for r in tables.passes_dosage(d, 3, 4, 0.1).collect()} == {"a"}
    assert not tables.passes_dosage(d, 3, 4, 0.5).collect()


def test_equal_columns_merge(spark):
    rows = [("s", "a", "p", 0.25), ("s", "a", "q", 0.25), ("s", "a", "r", 0.5), ("s", "b", "r", 1.0), ("t", "a", "p", 0.5), ("t", "a", "q", 0.5)]
    d = spark.createDataFrame(rows, "site string, sample string, path string, dosage double")
    got = {(r["site"], r["path"], r["sample"]): r["dosage"] for r in tables.merged_columns(d).collect()}
    assert got == {("s", "p", "a"): 0.5, ("s", "r", "a"): 0.5, ("s", "r", "b"): 1.0, ("t", "p", "a"): 0.5, ("t", "q", "a"): 0.5}
    assert {(r["site"], r["path"]) for r in tables.without_last(d).collect()} == {("s", "p"), ("s", "q"), ("t", "p")}


def test_least_squares():
    rng = np.random.default_rng(3)
    x = np.column_stack([np.ones(30), rng.random(30), rng.random(30)])
    y = x @ [1.0, 2.0, -1.0] + rng.normal(size=30) * 0.1
    beta, rss = np.linalg.lstsq(x, y, rcond=None)[:2]
    _, r2, b, se = stats.fit_ols(x, y, textbook=True)
    assert b == pytest.approx(beta[1]) and se == pytest.approx(math.sqrt(rss[0] / 27 * np.linalg.inv(x.T @ x)[1, 1]))
    assert r2 == pytest.approx(1 - rss[0] / ((y - y.mean()) ** 2).sum())
    assert stats.fit_ols(x, y)[3] == pytest.approx(math.sqrt(rss[0] / 28 * np.linalg.inv(x.T @ x)[1, 1]))
    assert stats.fit_ols(x[:, :1], y) is None


def test_logistic_uses_covariates():
    rng = np.random.default_rng(4)
    g, c = rng.integers(0, 3, 400) / 2.0, rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-(0.5 * g + 2 * c)))).astype(float)
    p, beta, se = stats.fit_logistic(np.column_stack([np.ones(400), g, c]), y, 1)
    alone = stats.fit_logistic(np.column_stack([np.ones(400), g]), y, 1)
    assert abs(beta / se) == pytest.approx(special_z(p), rel=1e-6)
    assert abs(beta - alone[1]) > 1e-3


def special_z(p):
    lo, hi = 0.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(mid / math.sqrt(2)) > p else (lo, mid)
    return lo


def test_near(spark):
    rng = random.Random(5)
    s = [(i, rng.choice("ab"), a := rng.randrange(10_000), a + rng.randrange(500)) for i in range(60)]
    g = [(i, rng.choice("ab"), a := rng.randrange(10_000), a + rng.randrange(900)) for i in range(60)]
    want = {(i, j) for i, c, a, b in s for j, d, x, y in g if c == d and not (y < max(a - 300, 0) or x > b + 300)}
    got = intervals.near(spark.createDataFrame(s, "site int, chr string, start long, end long"), spark.createDataFrame(g, "gene int, chr string, g_start long, g_end long"), 300).select("site", "gene").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_walks(spark):
    nested = {"p0": [0, 1, 3, 4, 5, 6, 7], "p1": [0, 1, 3, 4, 6, 7], "p2": [0, 2, 3, 7], "p3": [0, 2, 3, 4, 6, 7]}

    def parts(children, names):
        rows = [("s", n, n, c, 0, i, w[i + 1]) for n in names for w in [nested[n]] for i, c in enumerate(w[:-1]) if c in children]
        v = spark.createDataFrame(rows, "site string, hap string, sample string, child int, direction int, offset int, next int")
        return {tuple(r["samples"]) for r in walks.partitions(walks.signatures(v)).collect()}, v

    assert parts([0, 1, 2], nested)[0] == {("p0", "p1"), ("p2", "p3")}
    assert parts([3], nested)[0] == {("p0", "p1", "p3"), ("p2",)}
    assert parts([4, 5], nested)[0] == {("p0",), ("p1", "p3")}
    cohort = spark.createDataFrame([("p1", True), ("p3", True), ("p0", False), ("p2", False)], "sample string, is_case boolean")
    rows = {c: pipelines.graph(parts(c, nested)[1], cohort, False).first() for c in ((0, 1, 2), (3,), (4, 5))}
    shown = {c: (sci(r["p_fisher"]), sci(r["p_chi2"]), sorted(r["group_paths"].split(","))) for c, r in rows.items()}
    assert shown == {(0, 1, 2): ("1", "1", ["1:1", "1:1"]), (3,): ("1", "0.2482", ["0:1", "2:1"]), (4, 5): ("0.3333", "8.3265e-02", ["0:1", "2:0"])}
    assert {r["which"] for r in pipelines.graph(parts((4, 5), nested)[1], cohort, True).collect()} == {"case"}
    assert not pipelines.graph(parts((3,), nested)[1], cohort, True).collect()


def test_steps(spark):
    s = spark.createDataFrame([("p", i, i + 10, n) for i, n in enumerate([4, 4, 1, 4])], "path string, rank int, node int, len int")
    assert [r["offset"] for r in walks.step_offsets(s).orderBy("rank").collect()] == [0, 4, 8, 9]
    b = spark.createDataFrame([("s", "p", r) for r in (1, 4, 6, 9, 12)], "site string, path string, rank int")
    assert [(r["from_rank"], r["to_rank"]) for r in walks.boundary_pairs(b).orderBy("from_rank").collect()] == [(1, 4), (6, 9)]


@pytest.mark.parametrize(
    "links, start, end, cycle, want",
    [
        ([(2, 3), (2, 4), (3, 5), (4, 5)], 2, 5, 0, {"2>3>5", "2>4>5"}),
        ([(2, 4), (2, 3), (3, 4)], 2, 4, 0, {"2>4", "2>3>4"}),
        ([(2, 3), (3, 3), (3, 5), (2, 4), (4, 5)], 2, 5, 1, {"2>3>5", "2>3>3>5", "2>4>5"}),
        ([(1, 2), (2, 3), (3, 2), (2, 4), (3, 5), (4, 5)], 1, 5, 2, {"1>2>3>5", "1>2>3>2>3>5", "1>2>3>2>3>2>3>5", "1>2>3>2>3>2>4>5", "1>2>3>2>4>5", "1>2>4>5"}),
        ([(2, 6), (2, 3), (3, 6), (3, 4), (4, 6), (4, 5), (5, 6)], 2, 6, 0, {"2>6", "2>3>6", "2>3>4>6", "2>3>4>5>6"}),
    ],
)
def test_enumeration(spark, links, start, end, cycle, want):
    from bubblestat.sources.shared import ensure_checkpoints

    ensure_checkpoints(spark)
    l = spark.createDataFrame([("s", a, b) for a, b in links], "site string, a int, b int")
    found, given_up = decompose.enumerated(l, spark.createDataFrame([("s", start, end)], "site string, start int, end int"), cycle)
    assert {">".join(map(str, r["path"])) for r in found.collect()} == want
    assert not given_up.collect()
    _, given_up = decompose.enumerated(l, spark.createDataFrame([("s", start, end)], "site string, start int, end int"), cycle, budget=0)
    assert given_up.first()["reason"].startswith("iteration_calculation_out = ")


def write(path, text):
    path.write_text(text)
    return str(path)


def test_readers_refuse(spark, tmp_path):
    ok = write(tmp_path / "ok", "FID IID PHENO\ns1 s1 1\ns2 s2 2\n")
    assert {tuple(r) for r in readers.binary_phenotypes(spark, ok).collect()} == {("s1", False), ("s2", True)}
    with pytest.raises(ValueError, match="header"):
        readers.binary_phenotypes(spark, write(tmp_path / "h", "IID PHENO\ns1 1\n"))
    with pytest.raises(Exception, match="neither"):
        readers.binary_phenotypes(spark, write(tmp_path / "c", "FID IID PHENO\ns1 s1 0\n")).collect()
    with pytest.raises(Exception, match="no number"):
        readers.quantitative_phenotypes(spark, write(tmp_path / "q", "FID IID PHENO\ns1 s1 x\n")).collect()
    with pytest.raises(ValueError, match="no column"):
        readers.covariates(spark, write(tmp_path / "v", "IID\tPC1\ns1\t1\n"), ["PC2"])
    with pytest.raises(ValueError, match="no phenotype for s3"):
        readers.matched(spark.createDataFrame([("s3",)], "sample string"), readers.binary_phenotypes(spark, ok), "phenotype")
    with pytest.raises(ValueError, match="empty"):
        readers.sites(spark, write(tmp_path / "e", ""))


def test_gfa(spark, tmp_path):
    nodes, edges, steps = readers.gfa(spark, write(tmp_path / "g.gfa", "H\tVN:Z:1.0\nS\t1\tACGT\nS\t2\tA\nL\t1\t+\t2\t-\t0M\nP\tref\t1+,2-\t*\nW\ts1\t1\tc\t0\t5\t>1<2\n"))
    assert {tuple(r) for r in nodes.collect()} == {(1, "ACGT", 4), (2, "A", 1)}
    assert {tuple(r) for r in edges.collect()} == {(1, False, 2, True)}
    assert {tuple(r) for r in steps.collect()} == {("ref", "ref", 0, 0, 1, False), ("ref", "ref", 0, 1, 2, True), ("s1#1#c", "s1", 1, 0, 1, False), ("s1#1#c", "s1", 1, 1, 2, True)}


@pytest.fixture(scope="module")
def study(tmp_path_factory):
    """A VCF of two chromosomes, its sites and traits, and the calls as Python sees them."""
    d, rng = tmp_path_factory.mktemp("study"), random.Random(7)
    names = [f"s{i}" for i in range(24)]
    sites, vcf, carried = [], ["##fileformat=VCFv4.2", "\t".join("#CHROM POS ID REF ALT QUAL FILTER INFO FORMAT".split() + names)], []
    for c, base in (("c1", 0), ("c2", 1000)):
        for k in range(4):
            n = base + 10 * k + 1
            paths = [f">{n}>{n + 1}>{n + 3}", f">{n}>{n + 2}>{n + 3}", f">{n}>{n + 3}"]
            sites.append("\t".join([c, str(n), str(n + 3), "0", f"{n}_{n + 3}", ",".join(paths), "1,1,0", "1", "1"]))
            gts = [[rng.choice(["0", "1", "1" if i % 2 and k == 0 else "2", "."]) for _ in range(2)] for i in range(24)]
            vcf.append("\t".join([c, str(n), ".", "A", "C,G", ".", "PASS", f"AT={','.join(paths)};LV=0", "GT", *["|".join(g) for g in gts]]))
            carried += [(f"{n}_{n + 3}", paths[int(a)], names[i], 2 * i + h) for i, g in enumerate(gts) for h, a in enumerate(g) if a != "."]
        vcf.append("\t".join([c, str(base + 500), ".", "A", "C", ".", "PASS", f"AT=>{base + 1}>{base + 2},>{base + 1}>{base + 3};LV=1", "GT", *["0|1"] * 24]))
    write(d / "calls.vcf", "\n".join(vcf) + "\n")
    write(d / "sites.tsv", "\n".join(["\t".join(readers.SITE_HEADER), *sites]) + "\n")
    write(d / "binary.tsv", "FID IID PHENO\n" + "".join(f"{n} {n} {1 + i % 2}\n" for i, n in enumerate(names)))
    write(d / "quant.tsv", "FID IID PHENO\n" + "".join(f"{n} {n} {i * 0.5 + rng.random()}\n" for i, n in enumerate(names)))
    write(d / "cov.tsv", "IID\tSEX\tPC1\n" + "".join(f"{n}\t{i % 2}\t{rng.random()}\n" for i, n in enumerate(names)))
    write(d / "genes.tsv", "gene_name\tchr\tstart\tend\ng1\tc1\t5\t9\ng2\tc2\t900000\t900001\n")
    write(d / "expr.tsv", "gene\t" + "\t".join(names) + "\n" + "".join(f"{g}\t" + "\t".join(f"{rng.random():.4f}" for _ in names) + "\n" for g in ("g1", "g2")))
    return d, names, carried


def test_vcf_calls(spark, study):
    d, names, carried = study
    table = readers.sites(spark, str(d / "sites.tsv"))
    found = pipelines.present(readers.site_paths(table), readers.vcf_calls(spark, str(d / "calls.vcf")), readers.vcf_samples(spark, str(d / "calls.vcf")))
    assert {(r["site"], r["path"], r["sample"], r["hap"]) for r in found.collect()} == set(carried)


@pytest.mark.parametrize("flag, file, more, kind", [("-b", "binary.tsv", [], "binary"), ("-q", "quant.tsv", [], "quantitative"), ("-b", "binary.tsv", ["-c", "cov.tsv", "-C", "PC1,SEX"], "binary_covariates"), ("-e", "expr.tsv", ["-G", "genes.tsv"], "eqtl")])
def test_command_line(spark, study, tmp_path, flag, file, more, kind):
    d, _, carried = study
    at = lambda x: str(d / x) if x.endswith(".tsv") else x
    cli.run_vcf(spark, cli.checked(cli.parser().parse_args(["vcf", "-s", at("sites.tsv"), "-v", str(d / "calls.vcf"), flag, at(file), *map(at, more), "-w", "100", "-o", str(tmp_path)])))
    rows = spark.read.csv(f"{tmp_path}/{sinks.FILES[kind]}", sep="\t", header=True)
    assert rows.columns == sinks.HEADERS[kind].split()
    got = rows.collect()
    assert got
    if kind == "binary":
        for r in got:
            cells = {}
            for s, p, n, _ in carried:
                if s == r["SNARL"]:
                    cells.setdefault(p, [0, 0])[int(n[1:]) % 2] += 1
            assert sorted(r["GROUP_PATHS"].split(",")) == sorted(f"{a}:{b}" for a, b in cells.values())
    if kind == "eqtl":
        assert {r["GENE"] for r in got} == {"g1"}


def test_command_line_refuses():
    with pytest.raises(SystemExit):
        cli.checked(cli.parser().parse_args(["vcf", "-s", "a", "-v", "b", "-b", "c", "-c", "d"]))
    with pytest.raises(ValueError):
        pipelines.Settings(maf=2)
    with pytest.raises(ValueError):
        pipelines.Settings(min_individuals=1)
    assert sinks.with_suffix("/a/t.txt", "_s") == "/a/t_s.txt" and sinks.with_suffix("t", "_s") == "t_s"


def test_evaluation(spark):
    r = spark.createDataFrame([(1e-6, True), (0.5, True), (1e-9, False), (None, False)], "p double, truth boolean")
    got = evaluate.confusion(r, (1e-5,)).first()
    assert (got["tp"], got["fp"], got["fn"], got["tn"], got["precision"]) == (1, 1, 1, 1, 0.5)
    d = spark.createDataFrame([("s", "a", "p", 1.0), ("s", "b", "p", 0.5), ("s", "b", "q", 0.5), ("s", "c", "p", 0.25), ("s", "c", "q", 0.75)], "site string, sample string, path string, dosage double")
    assert {(x["genotype"], x["n"]) for x in evaluate.genotype_classes(d).collect()} == {("p/p", 1), ("p/q", 1), ("Other", 1)}


def test_entry(spark):
    import __spark_entry__ as e

    q, o = e.queries(), e.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50
    assert e.entry(spark).columns == ["site", "paths", "group_paths", "df", "chi2"]


def test_streaming(spark, study, tmp_path):
    from bubblestat.streaming.vcf import arriving

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "a.vcf", (study[0] / "calls.vcf").read_text())
    seen = []
    arriving(spark, str(tmp_path / "in"), str(tmp_path / "cp"), lambda df, n: seen.append(df.count())).awaitTermination()
    assert sum(seen) == 12


def test_walks_of_many_steps(spark):
    """A chain of 40 elements with one link back: its straight walk, and the one that goes round once, of 75 steps."""
    links = [(1, i, i + 1) for i in range(1, 40)] + [(1, 38, 3)]
    found, given_up = decompose.enumerated(spark.createDataFrame(links, "site long, a long, b long"), spark.createDataFrame([(1, 1, 40)], "site long, start long, end long"))
    straight = list(range(1, 41))
    assert sorted(r["path"] for r in found.collect()) == sorted([straight, straight[:38] + straight[2:]]) and given_up.count() == 0


def test_names_of_nodes_change_no_regression(spark):
    """A sample whose whole dosage is on the dropped path stays in the fit, and paths keep the order of the site's list whatever their text."""
    rng, out = __import__("random").Random(5), []
    takes = [[rng.randrange(2) for _ in range(2)] for _ in range(12)]
    pheno = [float(i % 5) + sum(t) for i, t in enumerate(takes)]
    traits = spark.createDataFrame([(f"s{i}", pheno[i], []) for i in range(12)], "sample string, pheno double, cov array<double>")
    cases = spark.createDataFrame([(f"s{i}", i % 2 == 0) for i in range(12)], "sample string, is_case boolean")
    for names in ((">1>2>4", ">1>3>4"), (">1>9>40", ">1>10>40")):
        present = spark.createDataFrame([("c", "x", k, names[k], f"s{i}", 2 * i + j) for i, t in enumerate(takes) for j, k in enumerate(t)], "chr string, site string, path_idx long, path string, sample string, hap long")
        q = pipelines.quantitative(present, traits, pipelines.Settings(min_individuals=2, min_haplotypes=2)).first()
        b = pipelines.binary(present, cases, pipelines.Settings(min_individuals=2, min_haplotypes=2, maf=0.0)).first()
        assert q["n"] == 12 and list(b["paths"]) == list(names)
        out.append((round(q["p"], 12), round(q["beta"], 12), b["group_paths"], b["chi2"]))
    assert out[0] == out[1]
    x = np.array([t.count(0) / 2 for t in takes])
    slope = np.cov(x, pheno, bias=True)[0, 1] / x.var()
    assert out[0][1] == pytest.approx(slope)


def test_trees_of_any_depth(spark):
    tree = [(i, i - 1 if i else None, i in (0, 150)) for i in range(400)] + [(1000, 2000, False), (1001, 1000, False), (3000, 3001, False), (3001, 3000, False)]
    got = {r["id"]: (r["placed_id"], r["is_own"]) for r in walks.nearest_placed(spark.createDataFrame(tree, "id long, parent long, placed boolean")).collect()}
    assert got == {i: (150 if i >= 150 else 0, i in (0, 150)) for i in range(400)} | {i: (None, False) for i in (1000, 1001, 3000, 3001)}


def test_fisher_of_many_tables(monkeypatch):
    rng = np.random.default_rng(3)
    t = rng.integers(0, 30, (4, 500))
    want = [special.fisher(*map(int, x)) for x in t.T]
    for cells in (1 << 22, 200, 10):
        got = special.fishers(*t, cells=cells)
        assert all(np.isnan(g) if w is None else g == pytest.approx(w, rel=1e-9) for g, w in zip(got, want))


@pytest.fixture(scope="module")
def graph_study(tmp_path_factory):
    """Sites 1_4 and 4_8 in a row, 5_7 inside 4_8; s3 walks backwards, s4 stops inside 4_8, and x is outside the cohort."""
    d = tmp_path_factory.mktemp("graph")
    walks_of = {"s0": ">1>2>4>5>6>7>8", "s1": ">1>2>4>5>7>8", "s2": ">1>3>4>8", "s3": "<8<4<3<1", "s4": ">1>2>4>5>7", "x": ">1>3>4>8"}
    lines = [f"S\t{n}\t{'ACGT'[n % 4] * n}" for n in range(1, 9)] + ["P\tref\t1+,2+,4+,8+\t*"]
    write(d / "g.gfa", "\n".join(lines + [f"W\t{s}\t0\tc\t0\t9\t{w}" for s, w in walks_of.items()]) + "\n")
    rows = [("1_4", ">1>2>4,>1>3>4", 1), ("4_8", ">4>5>0>7>8,>4>8", 1), ("5_7", ">5>6>7,>5>7", 2)]
    write(d / "sites.tsv", "\n".join(["\t".join(readers.SITE_HEADER), *(f"ref\t1\t2\t0\t{s}\t{p}\t1,1\t1\t{n}" for s, p, n in rows)]) + "\n")
    write(d / "tree.tsv", "\n".join(["\t".join(readers.TREE_HEADER), "1_4\tNA\t2\t3\t1", "4_8\tNA\t0\t18\t0", "5_7\t4_8\tNA\tNA\t0"]) + "\n")
    write(d / "pheno.tsv", "FID IID PHENO\n" + "".join(f"{s} {s} {1 + (s in ('s0', 's1', 's4'))}\n" for s in list(walks_of)[:5]))
    return d


@pytest.mark.parametrize("more, want", [(["-T", "chi2"], {"1_4": "3:0,0:2", "4_8": "2:0,0:2", "5_7": "1:0,2:0"}), ([], {"1_4": "NA", "4_8": "NA"}), (["-T", "chi2", "-l", "5"], {"4_8": "2:0,0:2", "5_7": "1:0,2:0"})])
def test_graph_command(spark, graph_study, tmp_path, more, want):
    d = graph_study
    args = ["graph", "-g", str(d / "g.gfa"), "-s", str(d / "sites.tsv"), "-d", str(d / "tree.tsv"), "-b", str(d / "pheno.tsv"), "-o", str(tmp_path), *more]
    cli.run_graph(spark, cli.checked(cli.parser().parse_args(args)))
    rows = {r["SNARL"]: r for r in spark.read.csv(f"{tmp_path}/{sinks.FILES['graph']}", sep="\t", header=True).collect()}
    for site, counts in want.items():
        assert sorted(rows[site]["GROUP_PATHS"].split(",")) == sorted(counts.split(","))
    assert set(rows) == set(want)
    place = {s: (r["#CHR"], r["START_POS"], r["END_POS"]) for s, r in rows.items()}
    at = {"1_4": ("ref", "1", "3"), "4_8": ("ref", "7", "7"), "5_7": ("ref", "7", "7")}  # 5_7 lies where its parent does
    assert place == {s: at[s] for s in rows}
    assert {s: r["PATH_LENGTHS"] for s, r in rows.items()} == {s: t for s, t in {"1_4": "2,3", "4_8": "0,18", "5_7": "NA,NA"}.items() if s in rows}


def test_graph_fasta(spark, graph_study, tmp_path):
    d = graph_study
    cli.run_graph(spark, cli.parser().parse_args(["graph", "-g", str(d / "g.gfa"), "-s", str(d / "sites.tsv"), "-b", str(d / "pheno.tsv"), "-O", "fasta", "-T", "chi2", "-o", str(tmp_path)]))
    records = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/{sinks.FILES['fasta']}").collect())
    assert ">snarl:1-4|ref:1-3|s0#0#c:1-3\nGG" in records and "|s2#0#c:1-4\nTTT" in records
    assert "x#0#c" not in records and ">snarl:5-7|NOREF" not in records


def test_visits_backwards(spark):
    """A path that walks a site from its end is the same walk; a last bound without a partner gives nothing."""
    steps = [("f", i, n, False) for i, n in enumerate([9, 1, 2, 3, 4, 9, 1, 2])] + [("b", i, n, True) for i, n in enumerate([4, 3, 2, 1])]
    s = spark.createDataFrame(steps, "path string, rank long, node long, rev boolean")
    v = walks.site_visits(s, spark.createDataFrame([("s", n) for n in (1, 2, 3, 4)], "site string, node long"), spark.createDataFrame([("s", 1, 4)], "site string, start long, end long"))
    found = walks.signatures(v.withColumns({"hap": F.col("path"), "sample": F.col("path")})).collect()
    assert len(found) == 2 and len({r["walk"] for r in found}) == 1 and found[0]["walk"] == "1/0/>2 2/0/>3 3/0/>4"
    empty = walks.site_visits(s.limit(0), spark.createDataFrame([("s", 1)], "site string, node long"), spark.createDataFrame([("s", 1, 4)], "site string, start long, end long"))
    assert not empty.collect()


def test_checks_of_names(spark):
    e = spark.createDataFrame([("g1", "s", 1.0), ("g2", "s", 2.0)], "gene string, sample string, expr double")
    with pytest.raises(ValueError, match="g2"):
        readers.positioned(e, spark.createDataFrame([("g1", "c", 1, 2)], "gene string, chr string, g_start long, g_end long"))
    refs = spark.createDataFrame([("p",), ("q",)], "path string")
    with pytest.raises(ValueError, match="q"):
        readers.found_references(refs, spark.createDataFrame([("p", 1)], "path string, rank int"))


def test_fork_pairs(spark):
    sites = spark.createDataFrame([("1_9", 1, 9, ">1>2>9,>1>3>9"), ("5_9", 5, 9, ">5>2>9,>5>3>9"), ("9_1", 9, 1, ">9>3>1,>9>2>1")], "site string, first long, last long, paths string")
    forks = spark.createDataFrame([(1, 2, 3), (1, 2, 4)], "start long, next_a long, next_b long")
    assert {tuple(r) for r in evaluate.fork_pairs_in_sites(forks, sites).collect()} == {(1, 2, 3, "1_9"), (1, 2, 3, "9_1")}
