"""Tallies of four-valued results, rates, intervals and matched pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright import schemas as S
from claimwright.operators.graph import _cut

#: Two-sided 95 % normal quantile (a fixed value).
Z95 = 1.959963984540054


def tally(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts per value; what is unknowable is not in the denominator."""
    counts = results.groupBy(*keys).agg(*(F.count_if(F.col("value") == v).alias(f"n_{v.lower()}") for v in S.VALUES))
    evaluable = F.col("n_true") + F.col("n_false") + F.col("n_unknown")
    return counts.withColumn("evaluable", evaluable).withColumn("rate", F.try_divide(F.col("n_true").cast("double"), F.col("evaluable").cast("double")))


def rate_ratio(a: Column, n: Column, c: Column, m: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Ratio of the rates a/n and c/m with its log-normal interval; null where a cell is zero."""
    some = (a > 0) & (c > 0) & (n > 0) & (m > 0)
    log = F.log((a / n) / (c / m))
    error = F.sqrt(1 / a - 1 / n + 1 / c - 1 / m)
    return F.when(some, F.exp(log)), F.when(some, F.exp(log - z * error)), F.when(some, F.exp(log + z * error))


def smoothed_ratio(a: Column, n: Column, c: Column, m: Column) -> Column:
    return ((a + 0.5) / (n + 1)) / ((c + 0.5) / (m + 1))


def age_band(years: Column) -> Column:
    return F.when(years.isNull(), "?").when(years <= 2, "0-2").when(years <= 5, "3-5").when(years <= 10, "6-10").when(years <= 20, "11-20").otherwise("21+")


def owner_band(owners: Column) -> Column:
    return F.least(owners, F.lit(6))


def fired_at_once(results: DataFrame, structural: list[str], key: str = "company") -> DataFrame:
    """fired, n: how many subjects have that many TRUE predicates, structural ones apart."""
    each = results.groupBy(key).agg(F.count_if((F.col("value") == S.TRUE) & ~F.col("predicate").isin(*structural)).alias("fired"))
    return each.groupBy("fired").agg(F.count(F.lit(1)).alias("n"))


def feature_separation(features: DataFrame, arms: DataFrame, least: int = 20) -> DataFrame:
    """feature, cases, controls, ratio for features (subject, feature) over arms (subject, is_case)."""
    sizes = arms.agg(F.count_if("is_case").alias("n"), F.count_if(~F.col("is_case")).alias("m"))
    rows = features.distinct().join(arms, "subject").groupBy("feature").agg(F.count_if("is_case").alias("cases"), F.count_if(~F.col("is_case")).alias("controls"))
    rows = rows.filter(F.col("cases") + F.col("controls") >= least).crossJoin(F.broadcast(sizes))  # one row
    ratio, low, high = rate_ratio(F.col("cases"), F.col("n"), F.col("controls"), F.col("m"))
    return rows.select("feature", "cases", "controls", ratio.alias("ratio"), low.alias("low"), high.alias("high"))


def ranked(rows: DataFrame, keys: list[str], *ident: str, out: str = "rank") -> DataFrame:
    """Rows numbered from 1 within each stratum by id, however large a stratum is.

    Rows are dealt by ranges of (stratum, id); each range numbers its own, and
    adds what the ranges before it hold of the stratum.
    """
    dealt = _cut(rows.repartitionByRange(*keys, *ident).withColumn("__range", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy("__range", *keys).orderBy(*ident))
    counts = dealt.groupBy("__range", *keys).agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__range", *keys, before.alias("__before"))
    # strata may be null in any key
    same = F.col("o.__range") == F.col("r.__range")
    for k in keys:
        same = same & F.col(f"o.{k}").eqNullSafe(F.col(f"r.{k}"))
    return dealt.withColumn("__own", own).alias("r").join(offsets.alias("o"), same).select(*(F.col(f"r.{c}") for c in rows.columns), (F.col("__own") + F.col("__before")).alias(out))


def matched_pairs(cases: DataFrame, controls: DataFrame, keys: list[str], *, ident: str = "subject") -> DataFrame:
    """Greedy 1:1 pairs without replacement: the i-th case of a stratum meets its i-th control, by id.

    With keys that do not depend on the case's date, taking the first free
    control in id order gives exactly the pairs of equal rank.
    """
    a = ranked(cases.select(*keys, F.col(ident).alias("case")), keys, "case")
    b = ranked(controls.select(*keys, F.col(ident).alias("control")), keys, "control")
    return a.join(b, [*keys, "rank"]).select(*keys, "case", "control")


def bunching(shares: DataFrame, threshold: str) -> Column:
    """Where a share lies around a threshold."""
    t, s = F.lit(threshold).cast(S.SHARE), F.col("share")
    two, one = F.lit("0.02").cast(S.SHARE), F.lit("0.01").cast(S.SHARE)
    return F.when((s >= t - two) & (s < t - one), "2pp below").when((s >= t - one) & (s < t), "1pp below").when(s == t, "at").when((s > t) & (s <= t + one), "1pp above")
