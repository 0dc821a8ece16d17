"""Corrections inside groups against plain sorting: one group of nearly all rows over many ranges, ties, missing values, a group without a name."""

import random

import pytest
from pyspark.sql import functions as F

from bubblestat.operators import evaluate, ranks, stats

RNG = random.Random(9)
ROWS = [(i, RNG.choice(["hot"] * 20 + ["a", "b", None]), RNG.choice([RNG.random() ** 3, 0.01, 0.5, 1.0])) for i in range(600)]


@pytest.fixture(scope="module")
def tests(spark):
    return spark.createDataFrame(ROWS, "id long, grp string, p double").repartition(5)


def groups():
    out = {}
    for i, g, p in ROWS:
        out.setdefault(g, []).append((p, i))
    return {g: sorted(v) for g, v in out.items()}


def test_holm(tests):
    want = {}
    for own in groups().values():
        top = 0.0
        for k, (p, i) in enumerate(own):
            top = max(top, (len(own) - k) * p)
            want[i] = min(1.0, top)
    got = stats.holm_adjusted(tests, "grp")
    assert got.columns == ["id", "grp", "p", "p_holm"]
    assert {r["id"]: r["p_holm"] for r in got.collect()} == pytest.approx(want)


def test_a_group_spans_ranges(tests):
    placed = ranks.ranked(tests, "grp", ["p", "id"], 8).collect()
    assert len({r["_range"] for r in placed if r["grp"] == "hot"}) >= 6
    for g, own in groups().items():
        assert sorted((r["_k"], r["id"]) for r in placed if r["grp"] == g) == [(k + 1, i) for k, (_, i) in enumerate(own)]
        assert {r["_n"] for r in placed if r["grp"] == g} == {len(own)}


def test_bonferroni_and_qq(tests):
    size = {g: len(v) for g, v in groups().items()}
    got = evaluate.bonferroni(tests, "grp")
    assert got.columns == ["id", "grp", "p", "p_bonferroni"]
    assert {r["id"]: r["p_bonferroni"] for r in got.collect()} == pytest.approx({i: min(1.0, p * size[g]) for i, g, p in ROWS})
    assert evaluate.qq(tests, "grp").count() == len(ROWS)


def test_missing_values_are_last(tests):
    some = tests.withColumn("p", F.when(F.col("id") % 3 > 0, F.col("p")))
    values = sorted((p if i % 3 else 1.0, i) for i, _, p in ROWS)
    want, least = {}, 1.0
    for k in range(len(values), 0, -1):
        p, i = values[k - 1]
        least = min(least, p * len(values) / k)
        want[i] = least
    got = stats.bh_adjusted(some).collect()
    assert {r["id"]: r["p_adjusted"] for r in got} == pytest.approx(want) and len(got) == len(ROWS)


def test_nothing(tests):
    assert stats.holm_adjusted(tests.limit(0), "grp").count() == 0 and stats.bh_adjusted(tests.limit(0)).count() == 0
