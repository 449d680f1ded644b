"""Stored bodies: what kind they are, their text, and the paths of JSON documents."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

#: Bytes that a compressed body may unpack to; a larger one is taken for none.
MOST_BYTES = 64 << 20


def _unpack(body: bytes | None) -> tuple[bytes | None, str]:
    """Bytes and what became of them: plain, unpacked, broken or too large."""
    import zlib

    if body is None or body[:2] != b"\x1f\x8b":
        return body, "plain"
    parts, left, rest = [], MOST_BYTES, body
    try:
        while rest[:2] == b"\x1f\x8b":  # members follow one another
            machine = zlib.decompressobj(31)
            parts.append(machine.decompress(rest, left + 1))
            left -= len(parts[-1])
            if left < 0:
                return None, "too large"
            if not machine.eof:
                return None, "broken"
            rest = machine.unused_data.lstrip(b"\0")  # padding
    except zlib.error:
        return None, "broken"
    return b"".join(parts), "unpacked"


@F.pandas_udf(BinaryType())
def unpacked(bodies: pd.Series) -> pd.Series:
    """Gunzipped bodies, all their members; others as they are; null where ``unpack_status`` says so."""
    return bodies.map(lambda b: _unpack(b)[0])


@F.pandas_udf(StringType())
def unpack_status(bodies: pd.Series) -> pd.Series:
    """plain, unpacked, broken, or too large (over MOST_BYTES)."""
    return bodies.map(lambda b: _unpack(b)[1])


def kind_of(body: Column) -> Column:
    """pdf, gzip, zip, xml, html, json, text or binary, by the first bytes."""
    head = F.substring(body, 1, 512)
    start = lambda *hexes: F.hex(F.substring(body, 1, 4)).rlike("^(" + "|".join(hexes) + ")")
    text = F.lower(F.ltrim(F.decode(head, "ISO-8859-1")))
    return (
        F.when(start("25504446"), "pdf")
        .when(start("1F8B"), "gzip")
        .when(start("504B0304"), "zip")
        .when(text.startswith("<?xml"), "xml")
        .when(text.rlike(r"^<(?:!doctype html|html|head|body|!--)"), "html")
        .when(text.rlike(r"^[\[{]"), "json")
        .when(text.rlike(r"[\x00-\x08]"), "binary")
        .otherwise("text")
    )


def decoded(body: Column) -> Column:
    """Text of a body: UTF-8 if it is well formed, else Latin-1."""
    return F.when(F.is_valid_utf8(body.cast("string")), body.cast("string")).otherwise(F.decode(body, "ISO-8859-1"))


def document_paths(documents: DataFrame, boring: tuple[str, ...] = (), depth: int = 3, col: str = "json") -> DataFrame:
    """path, documents: paths of values down to ``depth``, by the first element of lists; empty values and boring keys are left out."""
    level = documents.select(F.lit("").alias("path"), F.col(col).alias("value"))
    for _ in range(depth):
        # a value is parsed once for all its keys, and goes on beside them without being read again
        inner = F.map_entries(F.from_json("value", "map<string,string>"))
        named = F.filter(inner, lambda e: ~e["key"].isin(*boring, ""))
        first = lambda v: F.when(F.ltrim(v).startswith("["), F.get_json_object(v, "$[0]")).otherwise(v)
        keys = F.transform(named, lambda e: F.struct(F.concat_ws(".", F.when(F.col("path") != "", F.col("path")), e["key"]).alias("path"), first(e["value"]).alias("value")))
        full = F.filter(keys, lambda k: k["value"].isNotNull() & ~k["value"].isin("", "{}", "[]"))
        itself = F.array(F.struct("path", F.lit(None).cast("string").alias("value")))
        level = level.select(F.inline(F.concat(itself, F.coalesce(full, F.array().cast("array<struct<path:string,value:string>>")))))
    return level.filter("path <> ''").groupBy("path").agg(F.count(F.lit(1)).alias("documents"))
