"""A drop directory as a stream of uploads, and event windows (extensions to the batch modes)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import text as X
from ..operators import routing
from ..sources.files import BINARY


def uploads(spark: SparkSession, path: str, max_files: int = 1000, max_bytes: int = routing.MAX_BYTES) -> DataFrame:
    """New files in a directory, with the batch source's columns and guards."""
    found = spark.readStream.format("binaryFile").schema(BINARY).option("maxFilesPerTrigger", max_files).load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    return routing.guards(found.withColumns({"filename": X.safe_name(name), "content_type": X.guessed_type(name)}), max_bytes=max_bytes)


def distinct_uploads(files: DataFrame, within: str = "1 hour") -> DataFrame:
    """First of the uploads of the same content within the time."""
    return files.withColumn("digest", F.sha2("content", 256)).withWatermark("modificationTime", within).dropDuplicatesWithinWatermark(["digest"])


def run(files: DataFrame, process: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Process accepted files batch by batch; rejected ones go to a folder of their own."""

    def batch(df: DataFrame, n: int) -> None:
        process(df.where("status = 200")).write.mode("overwrite").json(f"{out}/pages/batch={n}")
        df.where("status <> 200").select("path", "status", "detail").write.mode("overwrite").json(f"{out}/rejected/batch={n}")

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_windows(events: DataFrame, time: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts per tumbling window and type; the same for batch and stream."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
