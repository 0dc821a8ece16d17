"""Regressions with a covariate, and their SQL by normal equations and by Newton's steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import genotype
from . import mapping as M
from . import pipelines
from .queries import _TWO, ORACLE_SQL, SETTINGS, _r, query


@query(
    M.SQL
    + _TWO
    + """, z AS (SELECT site, x, pheno AS y, nation AS c FROM two_x JOIN samples USING (sample)),
m AS (SELECT site, count(*) AS n, covar_pop(x, x) * count(*) AS xx, covar_pop(x, c) * count(*) AS xc, covar_pop(c, c) * count(*) AS cc, covar_pop(x, y) * count(*) AS xy, covar_pop(c, y) * count(*) AS cy, covar_pop(y, y) * count(*) AS yy FROM z GROUP BY site),
b AS (SELECT *, xx * cc - xc * xc AS det, (xy * cc - cy * xc) / (xx * cc - xc * xc) AS bx, (cy * xx - xy * xc) / (xx * cc - xc * xc) AS bc FROM m)
SELECT site, n, round(bx, 4) AS beta, round((bx * xy + bc * cy) / yy, 6) AS r2, round(sqrt((yy - bx * xy - bc * cy) / (n - 2) * cc / det), 4) AS se FROM b"""
)
def quantitative_covariates(spark, sf_dir):
    """Two paths and a covariate: dosage by least squares, residual degrees of freedom n - 2 as for three coefficients by the original's count."""
    traits = M.samples(spark, sf_dir).select("sample", "pheno", F.array(F.col("nation").cast("double")).alias("cov"))
    out = pipelines.quantitative(M.two_paths(spark, sf_dir), traits, SETTINGS)
    return out.select("site", "n", _r("beta", 4).alias("beta"), _r("r2").alias("r2"), _r("se", 4).alias("se"))


@query(ORACLE_SQL["quantitative_covariates"])
def quantitative_bitmap(spark, sf_dir):
    """The same from bitmaps: no row for a haplotype and path."""
    traits = M.samples(spark, sf_dir).select(F.col("sample").alias("sample_idx"), "pheno", F.array(F.col("nation").cast("double")).alias("cov"))
    out = pipelines.quantitative_bitmap(genotype.presence_bits(M.two_paths(spark, sf_dir)), traits, SETTINGS)
    return out.select("site", "n", _r("beta", 4).alias("beta"), _r("r2").alias("r2"), _r("se", 4).alias("se"))


@query(ORACLE_SQL["binary_assoc"])
def binary_bitmap(spark, sf_dir):
    """binary_assoc from bitmaps and masks of the cohort."""
    masks = genotype.masks(M.samples(spark, sf_dir).select(F.col("sample").alias("sample_idx"), "is_case"))
    out = pipelines.binary_bitmap(genotype.presence_bits(M.calls(spark, sf_dir)), masks, SETTINGS)
    return out.select("site", F.array_join("paths", ",").alias("paths"), "group_paths", "df", _r("chi2").alias("chi2"))


def _newton(steps: int) -> str:
    """SQL of Newton's steps for three coefficients with a ridge of 1e-4, each step by Cramer's rule."""
    det = "(h00 * (h11 * h22 - h12 * h12) - h01 * (h01 * h22 - h12 * h02) + h02 * (h01 * h12 - h11 * h02))"
    out = ["s0 AS (SELECT DISTINCT site, 0.0::DOUBLE AS b0, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2 FROM z)"]
    for i in range(steps + 1):
        mu = f"w{i} AS (SELECT z.*, b0, b1, b2, 1 / (1 + exp(-(b0 + b1 * x + b2 * c))) AS mu FROM z JOIN s{i} USING (site))"
        sums = f"h{i} AS MATERIALIZED (SELECT site, count(*) AS n, any_value(b0) AS b0, any_value(b1) AS b1, any_value(b2) AS b2, sum(mu * (1 - mu)) + 1e-4 AS h00, sum(mu * (1 - mu) * x) AS h01, sum(mu * (1 - mu) * c) AS h02, sum(mu * (1 - mu) * x * x) + 1e-4 AS h11, sum(mu * (1 - mu) * x * c) AS h12, sum(mu * (1 - mu) * c * c) + 1e-4 AS h22, sum(y - mu) - 1e-4 * any_value(b0) AS g0, sum((y - mu) * x) - 1e-4 * any_value(b1) AS g1, sum((y - mu) * c) - 1e-4 * any_value(b2) AS g2 FROM w{i} GROUP BY site)"
        out += [mu, sums]
        if i < steps:
            x0 = "(g0 * (h11 * h22 - h12 * h12) - h01 * (g1 * h22 - h12 * g2) + h02 * (g1 * h12 - h11 * g2))"
            x1 = "(h00 * (g1 * h22 - h12 * g2) - g0 * (h01 * h22 - h12 * h02) + h02 * (h01 * g2 - g1 * h02))"
            x2 = "(h00 * (h11 * g2 - g1 * h12) - h01 * (h01 * g2 - g1 * h02) + g0 * (h01 * h12 - h11 * h02))"
            out.append(f"s{i + 1} AS MATERIALIZED (SELECT site, b0 + {x0} / {det} AS b0, b1 + {x1} / {det} AS b1, b2 + {x2} / {det} AS b2 FROM h{i})")
    out.append(f"f AS (SELECT site, n, b1, sqrt((h00 * h22 - h02 * h02) / {det}) AS se FROM h{steps})")
    return ", ".join(out)


@query(
    M.SQL
    + f""", z AS (SELECT site, CASE WHEN a THEN 1.0 ELSE 0.0 END::DOUBLE AS x, CASE WHEN is_case THEN 1.0 ELSE 0.0 END::DOUBLE AS y, (nation / 25.0)::DOUBLE AS c
FROM (SELECT DISTINCT l_partkey % 50 AS site, o_custkey AS sample, o_custkey % 3 = 0 AS a FROM lineitem JOIN orders ON l_orderkey = o_orderkey) JOIN samples USING (sample)),
{_newton(9)}
SELECT site, n, round(b1, 5) AS beta, round(se, 5) AS se, round(1 - (SELECT sum(CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END * 2 / sqrt(pi()) * exp((2 * i + 1) * ln(greatest(abs(b1 / se / sqrt(2)), 1e-300)) - lgamma(i + 1)) / (2 * i + 1)) FROM generate_series(0, 120) AS g(i)), 5) AS p FROM f"""
)
def logistic_covariates(spark, sf_dir):
    """Two paths and a covariate by logistic regression: coefficient, error and p of the dosage."""
    traits = M.samples(spark, sf_dir).select("sample", F.col("is_case").cast("double").alias("pheno"), F.array(F.col("nation") / 25).alias("cov"))
    out = pipelines.binary_covariates(M.two_paths(spark, sf_dir, by_sample=True), traits, SETTINGS)
    return out.select("site", "n", _r("beta", 5).alias("beta"), _r("se", 5).alias("se"), _r("p", 5).alias("p"))
