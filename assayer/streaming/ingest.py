"""Ingesting an evidence log as it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from assayer.sources.documents import collected


def append_new(source: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what a streaming source holds and the last call hasn't taken; ends when that is done.

    Late rows are kept: a run's cut-off, not a watermark, says what it reads.
    """
    return source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def folder(spark: SparkSession, path: str, schema: str, files: int = 1000) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def sweep(bronze: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What a schedule starts: gives the bronze documents that no sweep has taken yet their states, appends them, and ends."""
    return append_new(collected(bronze), path, checkpoint)


def once_in_window(source: DataFrame, hours: int) -> DataFrame:
    """A stream of observations without repeats of a key inside the observation window."""
    return source.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", f"{hours} hours").dropDuplicatesWithinWatermark(["collector", "package_id"])


def per_window(source: DataFrame, width: str, late: str) -> DataFrame:
    """Counts of observations by fixed window and state."""
    return source.withColumn("observed_at", F.col("observed_at").cast("timestamp")).withWatermark("observed_at", late).groupBy(F.window("observed_at", width), "state").count()
