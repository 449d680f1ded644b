"""Connected components by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from claimwright.llm.common import cut


def components(edges: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label) for every node of ``edges`` (a, b): the least node of its component.

    ``known`` labels, of components of some of the edges, are where it starts.

    Every round takes the least label among neighbours (a partial aggregate,
    so a hub's edges are never gathered) and then the label's own label, which
    halves what is left of a chain.  Rounds are materialised in the shared
    checkpoint folder.
    """
    both = edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).distinct()
    both = cut(both)
    labels = both.groupBy("src").agg(F.min("dst").alias("to")).select(F.col("src").alias("node"), F.least("src", "to").alias("label"))
    if known is not None:
        before = known.select(F.col("node"), F.col("label").alias("was"))
        labels = labels.join(before, "node", "left").select("node", F.least("label", "was").alias("label"))
    labels = cut(labels)
    while True:
        heard = both.join(labels.withColumnsRenamed({"node": "dst"}), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("heard"))
        near = labels.join(heard, "node").select("node", "label", F.least("label", "heard").alias("next"))
        up = labels.select(F.col("node").alias("next"), F.col("label").alias("up"))
        moved = Observation()
        new = near.join(up, "next").select("node", F.least("next", "up").alias("label"), (F.least("next", "up") != F.col("label")).alias("moved"))
        labels = cut(new.observe(moved, F.max("moved").alias("any"))).select("node", "label")
        if not moved.get["any"]:
            return labels
