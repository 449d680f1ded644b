"""Pages as they arrive: refused, stored, told as held already, or as the text of another source.

The stream is keyed by the hash of what a page shows (case and spacing apart),
so equal texts meet whatever host they come from, and equal bytes of one
address meet too.  Of a text, the state holds its first source, and for each
address under which it came the bytes; the latter is a keyed map, so a text that a million
hosts serve is no large value.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from claimwright.functions.scalars import canonical_url, host_of, is_wall, normal_text
from claimwright.sources.pages import visible_text

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PAGE = "url string, payload binary, http_status int, fetched_at timestamp"
OUTCOME = "text_hash string, url string, source string, content_hash string, fetched_at timestamp, outcome string, same_text_as string"


def source_id(url: Column, content_hash: Column) -> Column:
    return F.concat(F.lit("web:"), host_of(url), F.lit("/"), F.substring(content_hash, 1, 10))


def read_pages(arrived: DataFrame) -> DataFrame:
    """url (canonical), fetched_at, content_hash, text_hash, source, refused (why a page is no document; null if it is one)."""
    text = arrived.select("url", "fetched_at", "http_status", F.sha2("payload", 256).alias("content_hash"), F.coalesce(visible_text("payload"), F.lit("")).alias("text"))
    refused = F.when(F.col("http_status") != 200, "status").otherwise(is_wall(F.col("text")))
    return text.select(canonical_url(F.col("url")).alias("url"), "fetched_at", "content_hash", F.sha2(normal_text(F.col("text")).cast("binary"), 256).alias("text_hash"), source_id(F.col("url"), F.col("content_hash")).alias("source"), refused.alias("refused"))


class SameText(StatefulProcessor):
    """Outcomes of the pages that show one text, in the order of (fetched_at, url)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "source string")
        self.held = handle.getMapState("held", "url string, content_hash string", "source string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        came = pd.concat(list(rows)).sort_values(["fetched_at", "url", "content_hash"])
        first = self.first.get()
        first = first[0] if first is not None else None
        out = []
        for r in came.itertuples():
            at = (r.url, r.content_hash)
            held = self.held.containsKey(at)
            if not held:
                self.held.updateValue(at, (r.source,))
            outcome = "held" if held else "stored"
            out.append((key[0], r.url, r.source, r.content_hash, r.fetched_at, outcome, None if held or first is None or first == r.source else first))
            if first is None:
                first = r.source
                self.first.update((first,))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in OUTCOME.split(", ")])

    def close(self) -> None:
        pass


def ingested(arrived: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Outcomes of the documents of a stream of pages, and the pages that were refused."""
    arrived.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    read = read_pages(arrived)
    good = read.filter("refused IS NULL").drop("refused")
    told = good.groupBy("text_hash").transformWithStateInPandas(SameText(), outputStructType=OUTCOME, outputMode="Append", timeMode="None")
    return told, read.filter("refused IS NOT NULL").select("url", "fetched_at", "refused")


def outcomes(arrived: DataFrame) -> DataFrame:
    """What ``ingested`` tells, of all pages at once."""
    order = Window.partitionBy("text_hash").orderBy("fetched_at", "url", "content_hash")
    good = read_pages(arrived).filter("refused IS NULL")
    seen = F.row_number().over(Window.partitionBy("text_hash", "url", "content_hash").orderBy("fetched_at"))
    first = F.first("source").over(order)
    rows = good.withColumn("n", seen).withColumn("first", first)
    twin = F.when((F.col("n") == 1) & (F.col("first") != F.col("source")), F.col("first"))
    return rows.select("text_hash", "url", "source", "content_hash", "fetched_at", F.when(F.col("n") > 1, "held").otherwise("stored").alias("outcome"), twin.alias("same_text_as"))
