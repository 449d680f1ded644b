"""Content-addressed blobs and append-only fetch logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def addressed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds content_hash and byte_len."""
    raw = F.col(payload).cast("binary")
    return payloads.withColumn("content_hash", F.sha2(raw, 256)).withColumn("byte_len", F.octet_length(raw).cast("long"))


def new_blobs(payloads: DataFrame, stored: DataFrame) -> DataFrame:
    """One row for each payload whose hash is not stored yet."""
    return payloads.dropDuplicates(["content_hash"]).join(stored.select("content_hash"), "content_hash", "left_anti")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def put(payloads: DataFrame, blobs: str, fetches: str) -> None:
    """Writes what is new to ``blobs`` and logs every fetch; blobs are written first, so that no log row lacks its blob."""
    spark = payloads.sparkSession
    rows = addressed(payloads)
    try:
        stored = spark.read.parquet(blobs)
    except Exception as e:  # an empty store
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        stored = rows.limit(0)
    append(new_blobs(rows, stored).select("content_hash", "payload", "byte_len"), blobs)
    append(rows.drop("payload"), fetches)


def latest_successful(fetches: DataFrame, keys: list[str]) -> DataFrame:
    """The newest fetch with status 200 for each key; of equal times the first logged."""
    order = Window.partitionBy(*keys).orderBy(F.col("fetched_at").desc(), F.col("seq").asc())
    return fetches.filter("http_status = 200").withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def content_versions(fetches: DataFrame, keys: list[str]) -> DataFrame:
    """The first successful fetch of each content, by key."""
    order = Window.partitionBy(*keys, "content_hash").orderBy("fetched_at", "seq")
    return fetches.filter("http_status = 200").withColumn("__rn", F.row_number().over(order)).filter("__rn = 1").drop("__rn")


def version_in_force(fetches: DataFrame, keys: list[str], on: str) -> DataFrame:
    """The newest successful fetch up to the end of a day."""
    rows = fetches.filter((F.col("http_status") == 200) & (F.col("fetched_at") < F.date_add(F.lit(on).cast("date"), 1)))
    return rows.groupBy(*keys).agg(F.max_by("content_hash", F.struct("fetched_at", "seq")).alias("content_hash"), F.max("fetched_at").alias("fetched_at"))


def store_stats(fetches: DataFrame) -> DataFrame:
    return fetches.groupBy("source").agg(F.count(F.lit(1)).alias("fetches"), F.count_distinct("content_hash").alias("contents"), F.sum("byte_len").alias("bytes"), F.count_if(F.col("http_status") == 200).alias("successful"))
