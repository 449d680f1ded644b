"""A content-addressed store that is written from chunks.

Chunks of a payload are hashed while they are written beside the store's
blobs; the finished file is then renamed to its own hash.  So an interrupted or
repeated task leaves no blob whose name lies, two writers of the same bytes
publish the same file, and what was there already stays.  The log row
is appended by Spark after the blob is in place, once for each payload, whether or not its bytes
were new.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.cluster import ship

#: What tells a payload, beside its chunks.
FETCH = ("source", "resource_type", "resource_id", "http_status", "fetched_at")


def blob_path(root: str, content_hash: str) -> str:
    return f"{root.rstrip('/')}/{content_hash[:2]}/{content_hash}"


def published(chunks: DataFrame, root: str) -> DataFrame:
    """payload, content_hash, byte_len, fresh (whether this task's bytes were new to the store): blobs of (payload, chunk, data).

    ``root`` is a folder, or a URI of a file system, that all executors reach.
    A payload's chunks go through one task, one at a time.
    """
    ship(chunks.sparkSession)

    def run(batches):
        import hashlib
        import itertools

        import pyarrow as pa
        from pyarrow import fs

        uri = re.sub(r"^file:/(?!/)", "file:///", root)
        where, base = fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), root)
        where.create_dir(f"{base}/.tmp", recursive=True)

        def rows():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), (x.as_py() for x in batch.column(1)), strict=True)

        for payload, some in itertools.groupby(rows(), key=lambda r: r[0]):
            digest, size, tmp = hashlib.sha256(), 0, f"{base}/.tmp/{uuid.uuid4().hex}"
            try:
                with where.open_output_stream(tmp) as out:
                    for _, data in some:
                        if data is not None:
                            digest.update(data)
                            out.write(data)
                            size += len(data)
                name = digest.hexdigest()
                target = blob_path(base, name)
                fresh = where.get_file_info(target).type == fs.FileType.NotFound
                if fresh:
                    where.create_dir(f"{base}/{name[:2]}", recursive=True)
                    where.move(tmp, target)  # the same bytes if another was faster
                else:
                    where.delete_file(tmp)
            except BaseException:
                if where.get_file_info(tmp).type != fs.FileType.NotFound:
                    where.delete_file(tmp)
                raise
            yield pa.RecordBatch.from_arrays([pa.array([payload], pa.string()), pa.array([name]), pa.array([size], pa.int64()), pa.array([fresh])], names=["payload", "content_hash", "byte_len", "fresh"])

    dealt = chunks.select(F.col("payload").cast("string").alias("payload"), "chunk", F.col("data").cast("binary").alias("data")).repartition("payload").sortWithinPartitions("payload", "chunk")
    return dealt.select("payload", "data").mapInArrow(run, "payload string, content_hash string, byte_len long, fresh boolean")


def put_stream(chunks: DataFrame, fetches: DataFrame, root: str, log: str) -> None:
    """Publish the blobs of ``chunks`` (payload, chunk, data), then append a log row for each of ``fetches`` (payload and FETCH).

    A fetch without chunks is one of no bytes.  The log is read as one table, with the ``run`` of each row.
    """
    known = fetches.select(F.col("payload").cast("string").alias("payload"), *FETCH)
    none = known.select("payload", F.lit(-1).alias("chunk"), F.lit(b"").alias("data"))
    all_chunks = chunks.select(F.col("payload").cast("string").alias("payload"), F.col("chunk").cast("int").alias("chunk"), F.col("data").cast("binary").alias("data")).join(known.select("payload"), "payload", "left_semi")
    done = published(all_chunks.unionByName(none), root).drop("fresh")
    # runs at the same time must not share a committer's folder
    known.join(done, "payload").drop("payload").write.mode("error").parquet(f"{log.rstrip('/')}/run={uuid.uuid4().hex}")


def put_objects(objects: DataFrame, root: str, log: str, key: str = "resource_id") -> None:
    """Snapshots: each row's ``object`` (a struct) as its canonical JSON, keys in the order of the struct."""
    body = F.to_json("object").cast("binary")
    rows = objects.withColumn("payload", F.col(key).cast("string"))
    put_stream(rows.select("payload", F.lit(0).alias("chunk"), body.alias("data")), rows.withColumn(key, F.col(key).cast("string")), root, log)


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """content_hash, byte_len of what is stored; Spark's file sources pass over the one blob without bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).drop("content")
    return files.select(F.element_at(F.split("path", "/"), -1).alias("content_hash"), F.col("length").alias("byte_len")).filter(F.col("content_hash").rlike("^[0-9a-f]{64}$"))
