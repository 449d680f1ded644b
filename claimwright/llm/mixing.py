"""Mixing sources to target weights by Poisson replication (native Spark SQL only).

Every document of source ``s`` is repeated a Poisson number of times with mean
``weight_s * total / n_s``.  The number comes from inverting the Poisson
distribution at a uniform value hashed from (seed, document id, text), so a
re-run or a lost executor gives the same copies.  Means above ``MAX_MEAN`` are split into
equal sub-draws (a sum of independent Poisson draws is Poisson), which bounds
the inverted table and avoids underflow.  The result is shuffled globally by a
hash of (seed, id, text, draw, copy).

Nulls: a null source is a source of its own; a null id or text hashes as ``''``.
Rows that repeat an id, or id and text, draw on their own: equal ones are numbered, and the
number is hashed with them (a table that repeats rows must be read alike again, as
files and checkpoints are).  An empty table gives an
empty result.  Extra columns are carried unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import cut, numbered_copies, small_or_shuffled

MAX_MEAN = 32.0
#: Terms of the inverted distribution: P(X > 160 | mean 32) < 1e-50.
TERMS = 160
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 10_000


def hashed_uniform(*parts: Column) -> Column:
    """52 bits of md5 as a value in [0, 1)."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_cdf(mean: Column) -> Column:
    """array<double>: P(X <= k) for k = 0..TERMS-1, by the term recurrence."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + p)).alias("cdf"))

    ks = F.sequence(F.lit(1), F.lit(TERMS - 1)).cast("array<double>")
    return F.aggregate(ks, start, step, lambda acc: acc["cdf"])


def source_rates(docs: DataFrame, weights: Mapping[str, float], default_weight: float, total: int | None, source: str) -> tuple[DataFrame, int]:
    """Per source: draws, the mean of each and its inverted distribution; and the number of sources."""
    counts = cut(docs.groupBy(F.col(source).alias("__mix_key")).agg(F.count(F.lit(1)).alias("__mix_n")))
    weight = F.lit(float(default_weight))
    for name, w in weights.items():
        weight = F.when(F.col("__mix_key") == name, F.lit(float(w))).otherwise(weight)
    weighted = counts.withColumn("__mix_w", weight)
    n_sources, n_docs, mass = weighted.agg(F.count(F.lit(1)), F.sum("__mix_n"), F.sum("__mix_w")).first()
    if not n_sources or not mass:
        mass, n_docs = 1.0, n_docs or 0
    mean = F.col("__mix_w") / F.lit(float(mass)) * F.lit(float(n_docs if total is None else total)) / F.col("__mix_n")
    draws = F.greatest(F.lit(1), F.ceil(mean / MAX_MEAN)).cast("int")
    rates = weighted.select("__mix_key", draws.alias("__mix_draws"), poisson_cdf(mean / draws).alias("__mix_cdf"))
    return rates, n_sources


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    *,
    default_weight: float = 1.0,
    total: int | None = None,
    seed: int = 17,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    copy_col: str | None = "copy",
) -> DataFrame:
    """All columns of ``docs``, plus ``copy_col`` (from 1) unless it is None.

    ``weights`` gives relative target weights by source; sources it does not
    name have ``default_weight``.  ``total`` is the expected number of rows
    (default: as many as came in).
    """
    names = docs.columns
    rates, n_sources = source_rates(docs, weights or {}, default_weight, total, source_col)
    ident = F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")))
    # drawn by the document's own hash: nothing but its source's few numbers is joined to it
    # hashed once, before copies are made
    keyed = numbered_copies(docs.withColumn("__mix_ident", ident), ["__mix_ident"], "__mix_number")
    keyed = keyed.withColumn("__mix_ident", F.concat_ws("|", "__mix_ident", F.when(F.col("__mix_number") > 0, F.col("__mix_number").cast("string")))).drop("__mix_number")
    joined = keyed.join(small_or_shuffled(rates, n_sources, BROADCAST_ROWS), F.col(source_col).eqNullSafe(F.col("__mix_key")))
    drawn = joined.withColumn("__mix_draw", F.explode(F.sequence(F.lit(1), F.col("__mix_draws"))))
    uniform = hashed_uniform(F.lit(str(seed)), F.col("__mix_ident"), F.col("__mix_draw").cast("string"))
    # bound to a variable, else it would be hashed again for each value that it is compared with
    times = F.element_at(F.transform(F.array(uniform), lambda u: F.size(F.filter("__mix_cdf", lambda c: c <= u))), 1)
    copies = drawn.withColumn("__mix_times", times).filter("__mix_times > 0")
    copies = copies.select(*names, "__mix_ident", "__mix_draw", F.explode(F.sequence(F.lit(1), F.col("__mix_times"))).alias("__mix_copy"))
    order = F.md5(F.concat_ws("|", F.lit(f"order{seed}"), F.col("__mix_ident"), F.col("__mix_draw").cast("string"), F.col("__mix_copy").cast("string")))
    shuffled = copies.withColumn("__mix_order", order).repartition("__mix_order").sortWithinPartitions("__mix_order")
    extra = [] if copy_col is None else [(F.col("__mix_copy") + (F.col("__mix_draw") - 1) * TERMS).cast("int").alias(copy_col)]
    return shuffled.select(*names, *extra)
