"""Components against a plain eigensolver, counts and sums against exact integers, odd vectors, ties, repeats, empty tables."""

import math

import numpy as np
import pytest

from bubblestat.llm import feast, whitening
from bubblestat.llm.queries import QUERIES

RNG = np.random.default_rng(12)


def _matrices():
    for n in (1, 2, 3, 5, 17, 64):
        a = RNG.standard_normal((3 * n, n))
        yield a.T @ a
        yield (b := a * np.exp(-np.arange(n) / 5)).T @ b
        yield (b := a[: max(1, n // 2)]).T @ b
        yield (b := np.repeat(a[:, :1], n, 1)).T @ b
        yield np.eye(n)
        yield (b := a * np.where(np.arange(n) == 0, 1e5, 100)).T @ b
    yield np.diag([5.0] * 20 + [3.0] * 30)
    yield np.diag([5.0] * 10 + [5 - 1e-9, 4, 3, 2])


@pytest.mark.parametrize("k", [1, 4, 16])
def test_components_equal_a_plain_solver(k):
    for v in _matrices():
        want = np.linalg.eigvalsh(v)[::-1]
        rank = int((want > 1e-13 * len(v) * want[0]).sum())
        diagonal, side = feast.tridiagonal(v)
        middles = (want[:-1] + want[1:])[want[:-1] - want[1:] > 1e-6 * want[0]] / 2
        assert all(feast.count_above(diagonal, side, middles) == [(want > m).sum() for m in middles])
        found = [feast.extracted(v, *p) for p in feast.intervals(diagonal, side, k)]
        e, x = np.concatenate([f[0] for f in found]), np.hstack([f[1] for f in found])
        assert len(e) >= min(k, rank) and np.allclose(e, want[: len(e)], rtol=0, atol=1e-13 * want[0])
        assert np.abs(v @ x - x * e).max() < 1e-13 * want[0] and np.abs(x.T @ x - np.eye(len(e))).max() < 1e-5  # by the least gap


def test_nothing_to_extract():
    assert feast.intervals(*feast.tridiagonal(np.zeros((3, 3))), 4) == []


def test_a_missed_eigenvalue_raises():
    with pytest.raises(ArithmeticError):
        feast.extracted(np.diag([4.0, 3.0, 1.0]), 2.5, 4.5, 3)


def _plain(rows, k=16):
    """{(vec_id, component): …} of [(vec_id, vector)] by exact integers and a full eigensolver."""
    sane = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    d = len(sane[0][1])
    own = sorted({tuple(x) for _, x in sane})
    n, sums = len(own), [sum(c) for c in zip(*own)]
    y = (np.array(own, object) * n - sums).astype(float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    keep = min(k, int((e > 1e-13 * d * e[0]).sum()))
    out = []
    for i, x in sane:
        z = [n * a - s for a, s in zip(x, sums)]
        w = np.array(z, float) / n @ u[:, :keep] / np.sqrt(e[:keep])
        out += [(i, c + 1, n, sum(a * a for a in z), w[c], e[c] / np.trace(v)) for c in range(keep)]
    return out


def _compare(got, want):
    """Equal but for each component's sign."""
    assert len(got) == len(want)
    order = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], abs(r[4]))
    got, want = sorted(got, key=order), sorted(want, key=order)
    signs = {}
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and abs(a[5] - b[5]) <= 1e-9 and abs(abs(a[4]) - abs(b[4])) < 1e-7
        if abs(b[4]) > 1e-3:
            assert signs.setdefault(a[1], a[4] * b[4] > 0) == (a[4] * b[4] > 0)


def test_rows(spark):
    vectors = RNG.standard_normal((300, 7)) * np.array([9, 5, 3, 2, 1, 0.5, 0.1])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)]
    rows += [(i, rows[3][1]) for i in range(1000, 1400)] + [(3, rows[3][1]), (None, rows[4][1])]
    odd = [(2000, None), (2001, []), (2002, [1.0] * 6 + [None]), (2003, [float("nan")] * 7), (2004, [float("inf")] + [0.0] * 6), (2005, [-float("inf")] * 7)]
    short = [(2006, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd + short], "vec_id long, embedding array<double>, x string, whitened int").repartition(5)
    model = whitening.fit(frame)
    done = whitening.whitened(frame, model)
    assert done.select("row.*").columns == frame.columns
    got = [(r["row"]["vec_id"], c + 1, model.n, r["deviation"], w, model.values[c] / model.trace) for r in done.collect() for c, w in enumerate(r["whitened"])]
    _compare(got, _plain(rows))
    assert model.identity_error < 1e-9


def test_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        model = whitening.fit(frame(rows))
        assert len(model.values) == 0 and all(r["whitened"] == [] for r in whitening.whitened(frame(rows), model).collect())
    two = frame([(1, [1.0, 2.0]), (2, [2.0, 2.0])])
    model = whitening.fit(two)
    assert model.n == 2 and len(model.values) == 1
    assert sorted(round(abs(r["whitened"][0]), 9) for r in whitening.whitened(two, model).collect()) == [1.0, 1.0]
    with pytest.raises(Exception, match="beyond a long"):
        whitening.whitened(frame([(1, [1e15, 0.0])]), whitening.fit(frame([(1, [1e15, 0.0]), (2, [0.0, 0.0])]))).collect()


def test_query(spark, tmp_path):
    import pyarrow.parquet as pq

    rows = pq.read_table("/root/testdata/sf0.001/embeddings.parquet").to_pylist()
    got = QUERIES["op12_whitening"](spark, "/root/testdata/sf0.001").collect()
    assert max(r["identity_error"] for r in got) < 1e-9
    _compare([tuple(r)[:6] for r in got], _plain([(r["vec_id"], r["embedding"]) for r in rows]))
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert QUERIES["op12_whitening"](spark, str(tmp_path)).count() == 0
