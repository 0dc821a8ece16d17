"""VCF files that arrive in a folder, analysed a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, folder: str, checkpoint: str, handle: Callable[[DataFrame, int], None], files_per_batch: int = 16) -> StreamingQuery:
    """Runs handle(lines, batch number) over the text lines of each batch of new files; a batch that fails is repeated as a whole.

    handle must write in a way that a repeat replaces, such as a folder named by the batch number."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(folder)
    return lines.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
