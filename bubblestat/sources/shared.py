"""The folder for checkpoints, and tables in it."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ensure_checkpoints(spark: SparkSession) -> None:
    """Takes the shared folder that the session names, or on one machine a temporary one."""
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(found or "file://" + tempfile.mkdtemp(prefix="spark-"))


def cut(df: DataFrame) -> DataFrame:
    """The same rows from a packed table in the folder for checkpoints; the shuffle files that led to it go."""
    spark = df.sparkSession
    ensure_checkpoints(spark)
    path, before = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/table-{uuid.uuid4().hex}", spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    return spark.read.schema(df.schema).parquet(path)
