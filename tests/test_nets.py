"""Sites of small graphs: parts, walks in order, lengths, places, and the command from a graph to the tables."""

import random
import re

import pytest

from bubblestat.operators import components, nets
from bubblestat.plans import cli
from bubblestat.sources import readers, sinks

#: Letters of nodes 1, 2 …, links, bounds of sites, the reference's nodes, cycle, and the wanted (site, paths, start, end, types).
GRAPHS = {
    "simple_snp": ("TTTT AAAA C G AAAA TTTT", "1>2 2>3 2>4 3>5 4>5 5>6", [">2>5"], "1 2 3 5 6", 0, [("2_5", ">2>3>5,>2>4>5", 8, 9, "1,1")]),
    "three_snp": ("TTTT AAAA C T G AAAA TTTT", "1>2 2>3 2>4 2>5 3>6 4>6 5>6 6>7", [">2>6"], "1 2 3 6 7", 0, [("2_6", ">2>3>6,>2>4>6,>2>5>6", 8, 9, "1,1,1")]),
    "fourth": ("TTTT AAAA T CA TCG CTAT AAAA TTTT", "1>2 2>3 2>4 3>5 4>6 3>6 5>7 6>7 7>8", ["<7<2"], "1 2 3 5 7 8", 0, [("7_2", ">2>3>5>7,>2>4>6>7,>2>3>6>7", 8, 12, "4,6,5")]),
    "deletion": ("TTTT AAAA C AAAA TTTT", "1>2 2>3 2>4 3>4 4>5", [">2>4"], "1 2 3 4 5", 0, [("2_4", ">2>4,>2>3>4", 8, 9, "0,1")]),
    "insert_snp": ("TTTT AAAA C GTT AAAA TTTT", "1>2 2>3 2>4 3>5 4>5 5>6", [">2>5"], "1 2 3 5 6", 0, [("2_5", ">2>3>5,>2>4>5", 8, 9, "1,3")]),
    "inversion": ("TTTT AAAA T AT CAT AAAA TTTT", "1>2 2>3 3>4 4>5 3<4 2>6 <4>5 5>6 6>7", ["<6<2", "<5<3"], "1 2 3 4 5 6 7", 0, [("6_2", ">2>6,>2>3>0>5>6", 8, 14, "0,6"), ("5_3", ">3>4>5,>3<4>5", 9, 11, "2,2")]),
    "large_deletion": ("TTTT AAAA GTT A T CCC G TT AAAA TTTT", "1>2 2>3 2>9 3>4 3>5 5>6 4>6 6>7 6>8 7>8 8>9 9>10", ["<9<2", "<8<6", "<6<3"], "1 2 9 10", 0, [("9_2", ">2>9,>2>3>0>8>9", 8, 8, "0,9/10"), ("8_6", ">6>8,>6>7>8", 8, 8, "0,1"), ("6_3", ">3>5>6,>3>4>6", 8, 8, "1,1")]),
    "loop_simple": ("TTTT AAAA A CG AAAA TTTT", "1>2 2>3 2>4 3>5 3>3 4>5 5>6", [">2>5"], "1 2 3 5 6", 1, [("2_5", ">2>3>5,>2>3>3>5,>2>4>5", 8, 9, "1,2,2")]),
    "loop": ("TTTT AAAA A CG AAAA TTTT", "1>2 2>3 2>4 3>5 3>2 4>5 5>6", [">1>5"], "1 2 3 5 6", 2, [("1_5", ">1>2>3>5,>1>2>3>2>3>5,>1>2>3>2>3>2>3>5,>1>2>3>2>3>2>4>5,>1>2>3>2>4>5,>1>2>4>5", 4, 9, "5,10,15,16,11,6")]),
    "loop_double": ("TTTT AAAA CG TC GG GA AAAA TTTT", "1>2 2>3 2>6 3>4 4>5 4>3 5>7 5>3 6>7 7>8", [">2>7"], "1 2 6 7 8", 2, [("2_7", ">2>3>4>5>7,>2>3>4>5>3>4>5>7,>2>3>4>5>3>4>5>3>4>5>7,>2>3>4>5>3>4>3>4>5>7,>2>3>4>3>4>5>7,>2>3>4>3>4>5>3>4>5>7,>2>3>4>3>4>3>4>5>7,>2>6>7", 8, 10, "10,20,30,28,18,28,26,2")]),
    "loop_plus": ("TTTT AAAA T G AT C A AAAA TTTT", "1>2 2>3 2>7 3>5 3>4 5>6 4>6 6>8 6>3 7>8 8>9", [">2>8", "<6<3"], "1 2 7 8 9", 1, [("2_8", ">2>3>0>6>8,>2>3>0>6>3>0>6>8,>2>7>8", 8, 9, "3/4,6/8,1"), ("6_3", ">3>5>6,>3>4>6", 8, 9, "2,1")]),
    "repetition": ("TTTT AAAA GTT CAA TGG AAAA TTTT", "1>2 2>3 3>4 4>5 5>6 6>7 2>6 3>6 4>6", [">2>6"], "1 2 6 7", 0, [("2_6", ">2>6,>2>3>6,>2>3>4>6,>2>3>4>5>6", 8, 8, "0,3,6,9")]),
    "complex_insertion": ("TTTT AAAA T G A C T AAAA TTTT", "1>2 2>3 2>7 3>4 3>5 2>8 4>6 5>6 5>7 6>8 7>8 8>9", [">2>8"], "1 2 7 8 9", 0, [("2_8", ">2>8,>2>3>4>6>8,>2>3>5>6>8,>2>3>5>7>8,>2>7>8", 8, 9, "0,3,3,3,1")]),
    "nested_snp": ("TTTT AAAA T G AT C T AAAA TTTT", "1>2 2>3 2>7 3>4 3>5 4>6 5>6 6>8 7>8 8>9", [">2>8", ">3>6"], "1 2 7 8 9", 0, [("2_8", ">2>3>0>6>8,>2>7>8", 8, 9, "3/4,1"), ("3_6", ">3>4>6,>3>5>6", 8, 9, "1,2")]),
    "nested_plus": ("TTTT AAAA A TT AC T C AAAA TTTT", "1>2 2>3 2>8 3>4 3>5 5>6 4>6 6>7 7>8 6>8 8>9", ["<8<2", "<6<3"], "1 2 3 4 6 8 9", 0, [("8_2", ">2>8,>2>3>0>6>7>8,>2>3>0>6>8", 8, 12, "0,5,4"), ("6_3", ">3>5>6,>3>4>6", 9, 11, "2,2")]),
}


def _links(text):
    out = []
    for one in text.split():
        (a, b) = re.fullmatch(r"([<>]?\d+)([<>]\d+)", one).groups()
        out.append((int(a.lstrip("<>")), a[0] == "<", int(b[1:]), b[0] == "<"))
    return out


def _moved(text, by):
    """Node numbers of a text, each more by some."""
    return re.sub(r"\d+", lambda m: str(int(m[0]) + by), text)


def gfa(graphs):
    """All graphs in one file: the nodes of the k-th are 100 k and more."""
    rows = ["H\tVN:Z:1.0"]
    for k, (letters, links, _, ref, *_) in graphs:
        rows += [f"S\t{100 * k + i + 1}\t{s}" for i, s in enumerate(letters.split())]
        rows += [f"L\t{a}\t{'-' if x else '+'}\t{b}\t{'-' if y else '+'}\t0M" for a, x, b, y in _links(_moved(links, 100 * k))]
        rows.append(f"P\tref{k}\t" + ",".join(f"{_moved(n, 100 * k)}+" for n in ref.split()) + "\t*")
    return "\n".join(rows) + "\n"


def bounds_table(graphs):
    ends = [_links(_moved(b, 100 * k))[0] for k, g in graphs for b in g[2]]
    return "\t".join(readers.BOUNDS_HEADER) + "\n" + "".join(f"{a}\t{int(x)}\t{b}\t{int(y)}\n" for a, x, b, y in ends)


@pytest.mark.parametrize("cycle", [0, 1, 2])
def test_known_graphs(spark, tmp_path, cycle):
    graphs = [(k, g) for k, g in enumerate(GRAPHS.values()) if g[4] == cycle]
    (tmp_path / "g.gfa").write_text(gfa(graphs))
    (tmp_path / "b.tsv").write_text(bounds_table(graphs))
    cli.main(["vcf", "-p", f"{tmp_path}/g.gfa", "-d", f"{tmp_path}/b.tsv", "-y", str(cycle), "-o", f"{tmp_path}/out"])
    rows = readers.sites(spark, f"{tmp_path}/out/{sinks.FILES['sites']}").collect()
    for k, g in graphs:
        own = [r for r in rows if r["chr"] == f"ref{k}"]
        got = {_moved(r["site"], -100 * k): (",".join(re.sub(r"[1-9]\d*", lambda m: str(int(m[0]) - 100 * k), p) for p in r["paths"]), r["start"], r["end"], ",".join(r["types"])) for r in own}
        assert got == {w[0]: w[1:] for w in g[5]}
        if g is GRAPHS["nested_plus"]:
            assert {_moved(r["site"], -100 * k): (r["is_ref"], r["depth"]) for r in own} == {"8_2": (True, 1), "6_3": (True, 2)}
    assert len({r["handle"] for r in rows}) == len(rows) == sum(len(g[5]) for _, g in graphs)
    assert spark.read.csv(f"{tmp_path}/out/{sinks.FILES['rejected']}", sep="\t", header=True).count() == 0


def _tree(spark, letters, links, bounds):
    nodes = spark.createDataFrame([(i + 1, len(s)) for i, s in enumerate(letters.split())], "node long, len long")
    edges = spark.createDataFrame([(*e, i) for i, e in enumerate(_links(links))], "a long, a_rev boolean, b long, b_rev boolean, ord long")
    ends = spark.createDataFrame([(a, x, b, y) for a, x, b, y in (_links(t)[0] for t in bounds)], "start long, start_rev boolean, end long, end_rev boolean")
    return nets.net(nodes, edges, ends)


def test_lengths_of_nested_sites(spark):
    """A site in a site in a site, and beside it one that goes round and round."""
    tree = _tree(spark, "A CC G TTT AAAA C GG T AA C T G", "1>2 2>3 3>4 4>6 3>6 2>5 5>7 6>7 7>8 1>8 8>9 9>10 10>9 9>11 10>11 8>11 11>12", [">1>8", ">2>7", ">3>6", ">8>11"])
    sites, chains = nets.measured(tree)
    got = {r["start"] // 2: (r["least"], r["most"]) for r in sites.collect()}
    assert got == {1: (0, 9), 2: (2, 5), 3: (0, 3), 8: (0, 3)}
    assert {r["site"]: r["depth"] for r in tree.sites.collect()} == {"1_8": 1, "2_7": 2, "3_6": 3, "8_11": 1}


def test_budgets(spark):
    tree = _tree(spark, "A C G T", "1>2 1>3 2>4 3>4", [">1>4"])
    for budget, ok in ((0, False), (1, False), (2, True)):
        found, rejected = nets.walks(tree, budget=budget)
        assert (found.count(), [r["reason"] for r in rejected.collect()]) == ((1, []) if ok else (0, ["iteration_calculation_out = 2 children"]))
    _, rejected = nets.walks(tree, max_children=1)
    assert [tuple(r) for r in rejected.collect()] == [("1_4", "too_many_children = 2 children")]


def test_search_orders_walks_as_taken_up():
    """Against a walk through the tree of choices: finds of one walk come before those of its longer ones, which come in the order of links."""
    rng = random.Random(3)

    def plain(walk, after, end, cycle):
        full = walk.count(walk[-1]) > cycle + 1
        here, longer = [], []
        for y in reversed(after.get(walk[-1], [])):
            if y == end:
                here.append([*walk, y])
            elif full:
                break
            else:
                longer.append(y)
        return here + [w for y in reversed(longer) for w in plain([*walk, y], after, end, cycle)]

    for _ in range(200):
        n = rng.randint(2, 6)
        links = list({(rng.randrange(n), rng.randrange(1, n + 1)) for _ in range(rng.randint(1, 9))})
        after = {}
        for x, y in links:
            after.setdefault(x, []).append(y)
        want = plain([0], after, n, 1)
        assert nets.search(0, n, [x for x, _ in links], [y for _, y in links], 1, 10**6) == want


def test_bounds_as_json(spark, tmp_path):
    (tmp_path / "b.json").write_text('{"type": 1, "start": {"node_id": "8", "backward": true}, "end": {"node_id": "2", "backward": true}}\n{"start": {"node_id": "3"}, "end": {"node_id": "6"}, "parent": {"start": {"node_id": "8"}}}\n')
    assert [tuple(r) for r in readers.site_bounds(spark, f"{tmp_path}/b.json").collect()] == [(8, True, 2, True), (3, False, 6, False)]
    (tmp_path / "b.tsv").write_text("A\tB\n1\t2\n")
    with pytest.raises(ValueError, match="header"):
        readers.site_bounds(spark, f"{tmp_path}/b.tsv")


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(7000, 7000)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = components.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["component"] for r in got} == {x: find(x) for x in root} and len(got) == len(root)


def test_sites_without_a_place_go(spark, tmp_path):
    graphs = [(0, GRAPHS["simple_snp"])]
    (tmp_path / "g.gfa").write_text(gfa(graphs).replace("ref0", "s#0#c"))
    (tmp_path / "b.tsv").write_text(bounds_table(graphs))
    args = ["vcf", "-p", f"{tmp_path}/g.gfa", "-d", f"{tmp_path}/b.tsv", "-o", f"{tmp_path}/out"]
    with pytest.raises(ValueError, match="-r names"):
        cli.main(args)
    (tmp_path / "r").write_text("s#0#c\n")
    cli.main([*args, "-r", f"{tmp_path}/r"])
    assert [r["chr"] for r in readers.sites(spark, f"{tmp_path}/out/{sinks.FILES['sites']}").collect()] == ["s#0#c"]


WALKS = {
    "nested": ("C C C A T C A C A A", "1>2 1>3 2>4 3>4 4>5 4>8 5>6 5>7 6>7 7>8 8>9 8>10 9>10", [">1>4", ">4>8", ">5>7"], {"path0": "1 2 4 5 6 7 8", "path1": "1 2 4 5 7 8", "path2": "1 3 4 8", "path3": "1 3 4 5 7 8"}, ["path1", "path3"]),
    "loop": ("A" * 10 + " A G C T " + "A" * 9, "1>2 2>3 2>4 3>4 4>5 5>2 5>6", ["<6<1", ">2>4"], {"path0": "1 2 3 4 5 6", "path1": "1 2 4 5 2 4 5 6", "path2": "1 2 3 4 5 2 4 5 6"}, ["path1", "path2"]),
}
#: Rows of the two graphs' tables, and of the classes of records one of each must be written.
ROWS = {
    ("nested", "chi2"): ["path0 1 2 1_4 1,1 1 1 1:1,1:1 1", "path0 3 6 4_8 0,3 1 0.2482 2:1,0:1 1", "path0 4 5 5_7 0,1 0.3333 8.3265e-02 0:1,2:0 2"],
    ("nested", "exact"): ["path0 4 5 5_7 0,1 NA NA NA 2"],
    ("loop", "chi2"): ["path0 10 14 6_1 3,4 0.3333 8.3265e-02 0:1,2:0 1", "path0 11 12 2_4 0,1 NA 0.2231 0:1,1:0,1:0 2"],
    ("loop", "exact"): ["path0 10 14 6_1 3,4 NA NA NA 1"],
}
RECORDS = {
    "nested": [{"1-4|path0:1-2|path0:1-2 C", "1-4|path0:1-2|path1:1-2 C"}, {"1-4|path0:1-2|path2:1-2 C", "1-4|path0:1-2|path3:1-2 C"}, {"4-8|path0:3-6|path0:3-6 TCA", "4-8|path0:3-6|path1:3-6 TA", "4-8|path0:3-6|path3:3-6 TA"}, {"4-8|path0:3-6|path2:3-3 "}, {"5-7|path0:4-5|path0:4-5 C"}, {"5-7|path0:4-5|path1:4-4 ", "5-7|path0:4-5|path3:4-4 "}],
    "loop": [{"6-1|path0:10-14|path0:10-14 AGCT"}, {"6-1|path0:10-14|path1:10-16 ACTACT", "6-1|path0:10-14|path2:10-17 ACTAGCT"}, {"2-4|path0:11-12|path0:11-12 G"}, {"2-4|path0:11-12|path1:11-11 "}, {"2-4|path0:11-12|path1:14-14 "}, {"2-4|path0:11-12|path2:11-12 G"}, {"2-4|path0:11-12|path2:15-15 "}],
}


@pytest.fixture(scope="module", params=WALKS)
def study(request, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    letters, links, bounds, paths, cases = WALKS[request.param]
    rows = [f"S\t{i + 1}\t{s}" for i, s in enumerate(letters.split())] + [f"L\t{a}\t+\t{b}\t+\t0M" for a, _, b, _ in _links(links)]
    (d / "g.gfa").write_text("\n".join([*rows, *(f"P\t{n}\t{','.join(x + '+' for x in p.split())}\t*" for n, p in paths.items())]) + "\n")
    (d / "b.tsv").write_text("\t".join(readers.BOUNDS_HEADER) + "\n" + "".join(f"{a}\t{int(x)}\t{b}\t{int(y)}\n" for a, x, b, y in (_links(t)[0] for t in bounds)))
    (d / "p.tsv").write_text("FID\tIID\tPHENO\n" + "".join(f"{n}\t{n}\t{1 + (n in cases)}\n" for n in paths))
    return request.param, d


@pytest.mark.parametrize("test", ["chi2", "exact"])
def test_graph_tables(spark, study, tmp_path, test):
    """Rows of the graph command on a graph with its bounds alone; which walk comes first is free."""
    name, d = study
    cli.main(["graph", "-g", f"{d}/g.gfa", "-d", f"{d}/b.tsv", "-b", f"{d}/p.tsv", "-r", "path0", "-T", test, "-o", str(tmp_path)])
    got = spark.read.csv(f"{tmp_path}/{sinks.FILES['graph']}", sep="\t", header=True).collect()
    loose = lambda row: [",".join(sorted(x.split(","))) for x in row]
    assert sorted(loose(map(str, r)) for r in got) == sorted(loose(r.split(" ")) for r in ROWS[name, test])


def test_graph_records(spark, study, tmp_path):
    name, d = study
    cli.main(["graph", "-g", f"{d}/g.gfa", "-d", f"{d}/b.tsv", "-b", f"{d}/p.tsv", "-r", "path0", "-T", "chi2", "-O", "fasta", "-o", str(tmp_path)])
    text = "\n".join(r[0] for r in spark.read.text(f"{tmp_path}/{sinks.FILES['fasta']}").collect())
    records = [" ".join((*x.split("\n"), "")[:2]) for x in text.split(">snarl:")[1:]]
    assert len(records) == len(RECORDS[name]) and all(sum(r in group for r in records) == 1 for group in RECORDS[name])
