"""Features that tell matched cases from controls, with one row for each variable.

Features that the same subjects have are one variable under several names.  They
are found by an order-free hash of each feature's members (128 bits, an
exclusive or that partial aggregates combine), so no set of members is gathered.
The intervals are corrected for the number of variables that were tested.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from claimwright.operators.stats import rate_ratio


@F.pandas_udf(DoubleType())
def normal_quantile(p: pd.Series) -> pd.Series:
    """The value that a standard normal one is below with probability ``p``; null outside (0, 1)."""
    import statistics

    inverse = statistics.NormalDist().inv_cdf
    return p.map(lambda x: inverse(x) if x is not None and 0 < x < 1 else None)


def corrected_z(tested: Column, level: float = 0.05) -> Column:
    """Two-sided quantile of a level shared by so many tests."""
    return -normal_quantile(F.lit(level) / F.greatest(tested, F.lit(1)) / 2)


def variables(features: DataFrame) -> DataFrame:
    """feature (the first of its names), identical (how many others it has), cases, controls, from (pair, is_case, feature)."""
    rows = features.select("pair", "is_case", "feature").distinct()
    member = lambda k: F.bit_xor(F.xxhash64(F.lit(k), "pair", "is_case")).alias(f"h{k}")
    each = rows.groupBy("feature").agg(F.count_if("is_case").alias("cases"), F.count_if(~F.col("is_case")).alias("controls"), member(1), member(2))
    return each.groupBy("h1", "h2", "cases", "controls").agg(F.min("feature").alias("feature"), (F.count(F.lit(1)) - 1).alias("identical")).select("feature", "identical", "cases", "controls")


def separation(features: DataFrame, pairs: DataFrame, least: int = 20, level: float = 0.05) -> DataFrame:
    """feature, identical, cases, controls, ratio, low, high: the furthest from 1 in either direction first, ties by name.

    ``pairs`` has a row for each matched pair; a count of none counts half in
    the ratio and has no interval.
    """
    rated = variables(features).filter(F.col("cases") + F.col("controls") >= least)
    sizes = pairs.agg(F.count(F.lit(1)).alias("n")).crossJoin(rated.agg(F.count(F.lit(1)).alias("tested")))  # one row
    rows = rated.crossJoin(F.broadcast(sizes.withColumn("z", corrected_z(F.col("tested"), level))))
    half = lambda c: F.when(F.col(c) == 0, 0.5).otherwise(F.col(c).cast("double"))
    _, low, high = rate_ratio(F.col("cases"), F.col("n"), F.col("controls"), F.col("n"), F.col("z"))
    rows = rows.select("feature", "identical", "cases", "controls", (half("cases") / half("controls")).alias("ratio"), low.alias("low"), high.alias("high"))
    return rows.orderBy(F.greatest("ratio", 1 / F.col("ratio")).desc(), "feature")


def gap_rates(subjects: DataFrame, open_gaps: DataFrame) -> DataFrame:
    """expectation, n_gaps, n_agenda, base_rate, agenda_rate over a cohort: gaps in the account, and those that asking a source could still close.

    ``open_gaps``: (subject, expectation, closable), as ``reports.gaps`` gives them.
    """
    n = subjects.agg(F.count_distinct("subject").alias("n"))
    kept = open_gaps.join(subjects.select("subject").distinct(), "subject", "left_semi").select("subject", "expectation", "closable").distinct()
    each = kept.groupBy("expectation").agg(F.count_if(~F.col("closable")).alias("n_gaps"), F.count_if("closable").alias("n_agenda"))
    rows = each.crossJoin(F.broadcast(n))  # one row
    return rows.select("expectation", "n_gaps", "n_agenda", (F.col("n_gaps") / F.col("n")).alias("base_rate"), (F.col("n_agenda") / F.col("n")).alias("agenda_rate"))
