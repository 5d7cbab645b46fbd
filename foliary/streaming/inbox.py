"""A folder watched for new files: each is read once, by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliary.sources.formats import detect_format

SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def watch(spark: SparkSession, path: str, sink: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that hands batches of (path, format, content, digest) to sink, without repeated contents."""
    files = spark.readStream.format("binaryFile").schema(SCHEMA).load(path)
    rows = files.select("path", "modificationTime", "content", detect_format(F.col("content"), F.col("path")).alias("format"), F.sha2("content", 256).alias("digest"))
    rows = rows.withWatermark("modificationTime", "1 day").dropDuplicatesWithinWatermark(["digest"])
    return rows.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
