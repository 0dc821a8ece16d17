"""Tails and logarithms against exact values."""

import math
from fractions import Fraction

import numpy as np
import pytest

from bubblestat.functions import special
from bubblestat.operators import stats
from bubblestat.sources import sinks


def test_log_gamma():
    x = np.concatenate([np.linspace(0.01, 30, 700), np.array([0.5, 1, 2, 1e3, 1e6, 1e9])])
    assert special._lgamma(x) == pytest.approx([math.lgamma(v) for v in x], rel=1e-13, abs=1e-13)
    assert special._lgamma(0) == math.inf


def test_far_tails():
    """Of two degrees of freedom the tail is exp(-x / 2); of four, that times 1 + x / 2."""
    x = np.array([1.0, 10.0, 80.0, 700.0, 2000.0, 1e5])
    assert special.chi2_log10_sf(x, 2.0) == pytest.approx(-x / 2 / math.log(10), rel=1e-12)
    assert special.chi2_log10_sf(x, 4.0) == pytest.approx((-x / 2 + np.log1p(x / 2)) / math.log(10), rel=1e-12)
    small = np.linspace(0.1, 60, 50)
    assert 10 ** special.chi2_log10_sf(small, 1.0) == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in small], rel=1e-11)


def test_text_of_logarithms():
    assert special.log10_text(-434.2944819) == "5.0760e-435" and special.log10_text(-435.00000001) == "1.0000e-435"
    assert special.log10_text(-3.0) == special.number_text(1e-3) and special.log10_text(None) == "NA"
    power = Fraction(10) ** -400 * Fraction(25, 10)
    assert special.log10_text(math.log10(power.numerator) - math.log10(power.denominator)) == "2.5000e-400"


def test_table_shows_far_tails(spark):
    rows = spark.createDataFrame([("a", ["x", "y"], [2000, 0], [0, 2000]), ("b", ["x", "y"], [20, 10], [10, 20])], "site string, paths array<string>, g0 array<long>, g1 array<long>")
    done = stats.tested(rows).selectExpr("*", "'c' AS chr", "1L AS start", "2L AS end", "array('1', '1') AS types", "'' AS group_paths", "1 AS depth")
    text = {r["SNARL"]: r["P_CHI2"] for r in sinks.as_text(done, "binary").collect()}
    assert text["b"] == "9.8233e-03" and text["a"].endswith("e-871")
