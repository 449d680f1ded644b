"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from claimwright.cluster import ship

#: Word separators of every contract here: space and TAB..CR.  ``bytes.split()``
#: without arguments splits on exactly this set.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process (tests)."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if there is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            there = tempfile.mkdtemp(prefix="cw-checkpoint-")
        sc.setCheckpointDir(there)
    return there


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared checkpoint folder and cut the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the rows seen while it was written, without another job.

    Work that is done again after a lost executor can be counted again, so the
    number may be too high, but it is 0 only for no rows.
    """
    seen = Observation()
    done = cut(df.observe(seen, F.count(F.lit(1)).alias("rows")))
    return done, seen.get["rows"]


def row_keys(*columns: Column) -> tuple[Column, Column]:
    """``k1`` and ``k2``: 128 bits that tell rows apart by these columns."""
    return F.xxhash64(F.lit(1), *columns).alias("k1"), F.xxhash64(F.lit(2), *columns).alias("k2")


def numbered_copies(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """``out`` long: rows equal in ``keys`` are numbered from 0, in no order among them.

    Where no row repeats, which one narrow count tells, nothing is shuffled.
    Otherwise a key's rows are numbered by partition, so a key that holds any
    share of the rows is dealt to as many tasks as it came in.
    """
    same = ["__copy_k1", "__copy_k2"]
    keyed = df.select("*", *(k.alias(s) for k, s in zip(row_keys(*(F.col(k) for k in keys)), same, strict=True)))
    if keyed.groupBy(*same).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        return df.withColumn(out, F.lit(0).cast("long"))
    placed = cut(keyed.withColumn("__copy_part", F.spark_partition_id()))
    counts = placed.groupBy(*same, "__copy_part").agg(F.count(F.lit(1)).alias("__copy_n"))
    before = F.sum("__copy_n").over(Window.partitionBy(*same).orderBy("__copy_part").rowsBetween(Window.unboundedPreceding, -1))
    # only keys that go on in a later partition say how many rows are before
    starts = counts.select(*same, "__copy_part", before.alias("__copy_before")).filter("__copy_before > 0")
    own = F.row_number().over(Window.partitionBy(*same, "__copy_part").orderBy(F.lit(0)))
    told = placed.withColumn("__copy_own", own).join(starts, [*same, "__copy_part"], "left")
    return told.select(*df.columns, (F.col("__copy_own") - 1 + F.coalesce("__copy_before", F.lit(0))).cast("long").alias(out))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64 (wraps on purpose)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def slices(batch, column: int, size: int) -> Iterator:
    """Stretches of an Arrow batch whose texts in ``column`` have about ``size`` bytes each, at least a row."""
    import pyarrow.compute as pc

    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        held += n or 0
        if held >= size:
            yield batch.slice(at, i + 1 - at)
            at, held = i + 1, 0
    if at < batch.num_rows:
        yield batch.slice(at)


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered up to a bound."""

    LIMIT = 250_000

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Order-sensitive 64-bit hash of every k consecutive values (len(h)-k+1 of them)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.zeros(n, np.uint64)
        for j in range(k):
            out = (out + h[j : j + n]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return mix64(out)


def small_or_shuffled(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """``broadcast`` hint only where the counted rows keep the side under the bound."""
    return F.broadcast(df) if rows <= bound else df
