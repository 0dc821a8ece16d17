"""Ranks inside groups of any size: rows are dealt by ranges of group and value, so a group spans as many tasks as it needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import ensure_checkpoints


def ranked(rows: DataFrame, key: str, order: list[str], chunks: int | None = None) -> DataFrame:
    """rows with _range (where a row was dealt to), _k (its place in its group, from 1) and _n (the group's rows); nulls come first.

    A range's counts of its groups give the places before it: a row for each range and group, never a group, meets in one task. Equal rows of `order` are put in some order: name what tells them apart."""
    ensure_checkpoints(rows.sparkSession)
    n = chunks or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, key, *order).withColumn("_range", F.spark_partition_id()).checkpoint()  # ranges are sampled: they must be dealt once only
    inner = W.partitionBy("_range", key)
    local = dealt.withColumn("_i", F.row_number().over(inner.orderBy(*order)))
    pieces = dealt.groupBy("_range", key).agg(F.count("*").alias("_c"))
    own = W.partitionBy(key)
    base = pieces.select(F.col("_range").alias("_r"), F.col(key).alias("_key"), F.coalesce(F.sum("_c").over(own.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_c").over(own).alias("_n"))
    joined = local.join(base, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn("_k", F.col("_before") + F.col("_i")).drop("_i", "_before", "_r", "_key")


def running_max(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """rows of ranked() with the greatest value of their group up to them, in its order."""
    valued = rows.withColumn("_v", value).checkpoint()
    tops = valued.groupBy("_range", key).agg(F.max("_v").alias("_top"))
    before = tops.select(F.col("_range").alias("_r"), F.col(key).alias("_key"), F.max("_top").over(W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)).alias("_top"))
    own = F.max("_v").over(W.partitionBy("_range", key).orderBy("_k").rowsBetween(W.unboundedPreceding, W.currentRow))
    joined = valued.withColumn("_own", own).join(before, (F.col("_range") == F.col("_r")) & F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.greatest("_own", "_top")).drop("_v", "_own", "_top", "_r", "_key")


def counted(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """rows with an aggregate of their group, joined: the aggregate has one row for each group."""
    of = rows.groupBy(F.col(key).alias("_key")).agg(value.alias(name))
    return rows.join(of, F.col(key).eqNullSafe(F.col("_key"))).drop("_key")
