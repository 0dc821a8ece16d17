"""Sites and the genes near them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def near(sites: DataFrame, genes: DataFrame, window: int = 1_000_000) -> DataFrame:
    """All columns of sites (chr, start, end) and genes (chr, g_start, g_end) that lie within window of each other; bounds count.

    Both sides are cut into bins of the window's width and meet in an equi-join on chromosome and bin, so no side need be small and no chromosome is one task. A
    pair is made in one bin only, the first that both touch.
    """
    low, high = F.greatest(F.col("start") - window, F.lit(0)), F.col("end") + window
    b = max(window, 1)
    s = sites.withColumn("_low", low).withColumn("_high", high).withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_low") / b), F.floor(F.col("_high") / b))))
    g = genes.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("g_start") / b), F.floor(F.greatest("g_start", "g_end") / b))))
    met = s.join(g, ["chr", "_bin"]).where((F.col("g_end") >= F.col("_low")) & (F.col("g_start") <= F.col("_high")))
    first = F.col("_bin") == F.floor(F.greatest("_low", "g_start") / b)
    return met.where(first).drop("_bin", "_low", "_high")
