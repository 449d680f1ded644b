"""Sharding by a fixed number of virtual slots.

A record belongs to one of ``SLOTS`` slots by the hash of its id and text, for
good.  Bytes and rows are counted by slot (a table of ``SLOTS`` rows at most, whatever the
input), and a versioned map says which shard holds a slot.  Versions are written
side by side and never changed; ``edited`` makes the next one and moves no more
slots than balance asks for, so rebalancing touches the map and the moved slots,
never a record's hash.

Rows that repeat id and text are numbered, and the number is hashed with them:
copies in mass spread over slots like other records.

Nulls: a null id or text hashes as an empty one; a null text has size 1, as an
empty one has.  Ties between slots go to the smaller slot, between shards to the
smaller shard.  An empty table gives no rows and a map without bytes.  Columns with clashing names
are not read by ``placed`` and are carried by ``routed``.
"""

from __future__ import annotations

import heapq
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimwright.llm.common import cut, ensure_checkpoint_dir, numbered_copies

SLOTS = 4096
MAP_SCHEMA = "version int, slot int, shard int, bytes long, rows long"


def slot_of(ident: Column, text_crc32: Column, size: Column, copy: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a record."""
    parts = F.concat_ws("|", F.coalesce(ident.cast("string"), F.lit("")), text_crc32.cast("string"), size.cast("string"), copy.cast("string"))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 8), 16, 10).cast("long").__mod__(slots).cast("int")


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy, vslot of every row; texts go no further."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = numbered_copies(cut(rows), ["doc_id", "text_crc32", "size"], "copy")
    return rows.withColumn("vslot", slot_of(F.col("doc_id"), F.col("text_crc32"), F.col("size"), F.col("copy"), slots))


def slot_sizes(rows: DataFrame) -> DataFrame:
    """slot, bytes, rows."""
    return rows.groupBy(F.col("vslot").alias("slot")).agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def edited(sizes: dict[int, tuple[int, int]], shards: int, before: dict[int, int] | None = None, slots: int = SLOTS) -> dict[int, int]:
    """slot -> shard for every slot: ``before`` with the moves that bring ``shards`` shards near equal bytes.

    Slots are taken by falling bytes.  One without a shard (in the first
    version, or of a shard that is given up) goes to the shard with fewest
    bytes; so does one whose shard holds the mean and more without it (the mean
    of what is left when slots larger than it have shards of their own).
    """
    before = {s: k for s, k in (before or {}).items() if k < shards}
    weight = {s: sizes.get(s, (0, 0))[0] for s in range(slots)}
    # the mean of what can be shared out: a slot above it fills a shard alone
    total, left, loads = sum(weight.values()), shards, [0] * shards
    for w in sorted(weight.values(), reverse=True):
        if left == 1 or w * left <= total:
            break
        total, left = total - w, left - 1
    for s, k in before.items():
        loads[k] += weight[s]
    least = [(load, k) for k, load in enumerate(loads)]
    heapq.heapify(least)
    after = {}
    for s in sorted(weight, key=lambda s: (-weight[s], s)):
        here = before.get(s)
        if here is not None and (not weight[s] or (loads[here] - weight[s]) * left < total):
            after[s] = here
            continue
        while least[0][0] != loads[least[0][1]]:  # told before its shard changed
            heapq.heappop(least)
        to = least[0][1]
        if here is not None:
            loads[here] -= weight[s]
            heapq.heappush(least, (loads[here], here))
        loads[to] += weight[s]
        heapq.heappush(least, (loads[to], to))
        after[s] = to
    return after


def save_map(spark: SparkSession, path: str, version: int, shards: dict[int, int], sizes: dict[int, tuple[int, int]]) -> DataFrame:
    """Write a version of the map; one that is there already is an error, not replaced."""
    rows = [(version, s, k, *sizes.get(s, (0, 0))) for s, k in sorted(shards.items())]
    where = f"{path}/version={version}"
    spark.createDataFrame(rows, MAP_SCHEMA).drop("version").coalesce(1).write.mode("error").parquet(where)
    return load_map(spark, path, version)


def load_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    """version, slot, shard, bytes, rows of one version."""
    return spark.read.parquet(f"{path}/version={version}").select(F.lit(version).alias("version"), "slot", "shard", "bytes", "rows")


def first_map(rows: DataFrame, shards: int, path: str, slots: int = SLOTS) -> DataFrame:
    """Version 1: measured rows' slots dealt to shards by bytes."""
    sizes = _held(slot_sizes(rows))
    return save_map(rows.sparkSession, path, 1, edited(sizes, shards, None, slots), sizes)


def next_map(current: DataFrame, shards: int, path: str, sizes: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """The next version, for another number of shards or for new ``slot_sizes``."""
    held = {r.slot: r for r in current.collect()}  # SLOTS rows
    now = {s: (r.bytes, r.rows) for s, r in held.items()} if sizes is None else _held(sizes)
    version = next(iter(held.values())).version + 1
    return save_map(current.sparkSession, path, version, edited(now, shards, {s: r.shard for s, r in held.items()}, slots), now)


def _held(sizes: DataFrame) -> dict[int, tuple[int, int]]:
    """At most ``SLOTS`` rows."""
    return {r.slot: (r.bytes, r.rows) for r in sizes.collect()}


def routed(docs: DataFrame, shard_map: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, shard_col: str = "shard") -> DataFrame:
    """``docs`` with the shard of each row, ready to be written by shard; no text is shuffled unless rows repeat."""
    names = [c for c in docs.columns if c != shard_col]
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(*names, F.crc32(text.cast("binary")).alias("__crc"), (F.octet_length(text) + 1).cast("long").alias("__size"))
    keyed = numbered_copies(keyed, [id_col, "__crc", "__size"], "__copy").withColumn("__slot", slot_of(F.col(id_col), F.col("__crc"), F.col("__size"), F.col("__copy"), slots))
    by = F.broadcast(shard_map.select(F.col("slot").alias("__slot"), F.col("shard").alias("__shard")))  # SLOTS rows
    return keyed.join(by, "__slot").select(*names, F.col("__shard").alias(shard_col))


def placed(rows: DataFrame, shard_map: DataFrame) -> DataFrame:
    """Measured rows with their shard and gapless place in it: by slot, and in a slot by id, checksum and copy.

    A slot's rows follow those of its shard's smaller slots, which the map
    counts; so a place takes a rank among a slot's rows, never a whole shard's.
    """
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1))
    starts = shard_map.select(F.col("slot").alias("vslot"), "shard", F.col("version").alias("map_version"), F.coalesce(before, F.lit(0)).alias("__start"))
    own = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size", "copy"))
    return rows.withColumn("__own", own).join(F.broadcast(starts), "vslot").withColumn("slot", F.col("__start") + F.col("__own") - 1).drop("__start", "__own")


def sharded(docs: DataFrame, shards: int = 8, *, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, copy, vslot, shard, map_version, slot and the shard in the next version of the map, with one shard more.

    ``path`` holds the map's versions; without it they are written beside the checkpoints.
    """
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    rows = cut(measured(docs, slots=slots))
    now = first_map(rows, shards, path, slots)
    grown = next_map(now, shards + 1, path, slots=slots).select(F.col("slot").alias("vslot"), F.col("shard").alias("next_shard"))
    return placed(rows, now).join(F.broadcast(grown), "vslot")
