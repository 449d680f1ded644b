"""Scans of the formats that sources come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def packed_list(col: str, sep: str = ";") -> Column:
    """Trimmed non-empty values of a packed column."""
    return F.filter(F.transform(F.split(F.col(col), sep), lambda x: F.trim(x)), lambda x: x != "")


def designations(spark: SparkSession, path: str) -> DataFrame:
    """A designation list (CSV with ``;``-packed aliases, countries, identifiers and programmes)."""
    raw = spark.read.option("header", True).option("multiLine", False).csv(path)
    lists = ("aliases", "countries", "identifiers", "program_ids")
    return raw.select("id", "schema", "name", *(packed_list(c).alias(c) for c in lists), "dataset")


def delimited(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A ``;``-separated register export with a header."""
    return spark.read.option("header", True).option("sep", ";").option("encoding", "UTF-8").schema(schema).csv(path)


def json_rows(spark: SparkSession, path: str, schema: str, *, array: bool = False) -> DataFrame:
    """Rows of NDJSON files, or of files that each hold one array (read whole, so such files should be small)."""
    return spark.read.schema(schema).option("multiLine", array).json(path)


def captures(rows: DataFrame, col: str = "cdx") -> DataFrame:
    """url, fetched_at, http_status, content_hash, byte_len from archive index answers; the header and short rows are skipped."""
    each = rows.select(F.posexplode(F.from_json(F.col(col), "array<array<string>>")).alias("pos", "r")).filter("pos > 0 AND size(r) >= 4")
    number = lambda i: F.get("r", F.lit(i)).try_cast("int")
    return each.select(
        F.get("r", F.lit(1)).alias("url"),
        F.try_to_timestamp(F.get("r", F.lit(0)), F.lit("yyyyMMddHHmmss")).alias("fetched_at"),
        number(2).alias("http_status"),
        F.get("r", F.lit(3)).alias("content_hash"),
        number(4).alias("byte_len"),
    )


def whois(rows: DataFrame, key: str, col: str = "text") -> DataFrame:
    """key, fields map, hostnames: ``key: value`` lines, the first of each key; refusals are left out."""
    lines = F.filter(F.split(F.col(col), "\n"), lambda x: x.rlike(r"^\s*[A-Za-z][^:]*:\s*\S"))
    name = lambda x: F.lower(F.trim(F.substring_index(x, ":", 1)))
    value = lambda x: F.trim(F.regexp_replace(x, r"^[^:]*:\s*", ""))
    pairs = F.transform(lines, lambda x: F.struct(name(x).alias("k"), value(x).alias("v")))
    first = F.aggregate(
        pairs,
        F.expr("cast(map() as map<string,string>)"),
        lambda acc, p: F.when(F.map_contains_key(acc, p["k"]), acc).otherwise(F.map_concat(acc, F.create_map(p["k"], p["v"]))),
    )
    hosts = F.transform(F.filter(pairs, lambda p: p["k"] == "hostname"), lambda p: p["v"])
    refused = F.lower(F.col(col)).rlike("quota exceeded|too many requests|rate limit")
    return rows.filter(~F.coalesce(refused, F.lit(True))).select(key, first.alias("fields"), hosts.alias("hostnames"))
