"""Incremental ingestion of a fetch log (an extension: the claim model itself is batch).

A file stream of JSON rows is appended to a Parquet log; the newest successful
fetch per key can be kept up to date with a watermark that bounds the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FETCH = "content_hash string, source string, resource_type string, resource_id string, fetched_at timestamp, http_status int, byte_len long, seq long"


def fetch_stream(spark: SparkSession, folder: str, *, files_per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.schema(FETCH).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def append_log(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends what arrived since the last run; the file sink's log makes a repeated batch harmless."""
    return stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def hourly_status(stream: DataFrame, late: str = "2 hours") -> DataFrame:
    """window_start, source, fetches, successful: hourly counts, closed once the watermark has passed."""
    counted = stream.withWatermark("fetched_at", late).groupBy(F.window("fetched_at", "1 hour").alias("w"), "source")
    return counted.agg(F.count(F.lit(1)).alias("fetches"), F.count_if(F.col("http_status") == 200).alias("successful")).select(F.col("w.start").alias("window_start"), "source", "fetches", "successful")
