"""Predicates over expanded ownership chains (root, node, depth, stop)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright import schemas as S

#: Stops that our own limits caused.
OURS = ("max_depth", "budget")


def shape(chain: DataFrame) -> DataFrame:
    g = chain.groupBy("root").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("depth"))
    return g.select("root", F.when(F.col("nodes") <= 1, S.UNKNOWABLE).otherwise(S.TRUE).alias("value"), "nodes", "depth")


def terminates_unresolvable(chain: DataFrame) -> DataFrame:
    """Nothing unresolvable, but cut short by our limits: unknown; nothing at all: false."""
    g = chain.groupBy("root").agg(F.count_if(F.col("stop") == "unresolvable").alias("opaque"), F.count_if(F.col("stop").isin(*OURS)).alias("cut"))
    value = F.when(F.col("opaque") > 0, S.TRUE).when(F.col("cut") > 0, S.UNKNOWN).otherwise(S.FALSE)
    return g.select("root", value.alias("value"))


def owners_are_named_persons(chain: DataFrame, edges: DataFrame) -> DataFrame:
    """Whether every leaf is a person; a leaf that our limits cut off leaves it unknown."""
    leaf = chain.filter("depth > 0").join(edges.select(F.col("owned").alias("node")).distinct().join(chain.filter("stop IS NULL").select("node").distinct(), "node"), "node", "left_anti")
    g = leaf.groupBy("root").agg(F.count_if(F.col("stop").isin(*OURS)).alias("cut"), F.bool_and(F.coalesce(F.col("stop") == "natural_person", F.lit(False))).alias("named"))
    out = chain.select("root").distinct().join(g, "root", "left")
    return out.select("root", F.when(F.col("named").isNull(), S.UNKNOWABLE).when(F.col("cut") > 0, S.UNKNOWN).when(F.col("named"), S.TRUE).otherwise(S.FALSE).alias("value"))


def designated(chain: DataFrame, labels: DataFrame, listed: DataFrame) -> DataFrame:
    """root, node: the first listed node of a chain by key; ``labels`` (node, name_key), ``listed`` (name_key)."""
    hits = chain.join(labels, "node").join(listed.select("name_key").distinct(), "name_key", "left_semi")
    return hits.groupBy("root").agg(F.min("node").alias("node"))
