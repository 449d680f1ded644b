"""What a cohort of companies looks like: six booleans of each, rates by number of owners, common shares, roles a person."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright import schemas as S
from claimwright.operators.shares import per_holder
from claimwright.operators.stats import owner_band

PROFILE = ("nominee_density", "voting_exceeds_equity", "majority_owner_unresolvable", "unusual_ownership_percentage", "subthreshold_aggregate_over_50", "ownership_residual_unaccounted")


def company_profile(owns: DataFrame, votes: DataFrame, people: DataFrame, on: date | str, opaque: Column) -> DataFrame:
    """company, owners and the booleans of ``PROFILE``, of companies with a quantified owner on the day.

    ``people`` (company, directorships) are those of a company with how many
    companies each directs; ``opaque`` tells, of ``owns``, holders that no
    register resolves.  Equity and votes are brought together by holder once and by company once.
    """
    share = lambda x: F.lit(x).cast(S.SHARE)
    unresolved = owns.select("holder", opaque.alias("opaque")).distinct()
    filed = per_holder(owns, on).select("company", "holder", F.col("share").alias("equity"), F.lit(None).cast(S.SHARE).alias("vote"))
    voted = per_holder(votes, on).select("company", "holder", F.lit(None).cast(S.SHARE), F.col("share"))
    both = filed.unionAll(voted).groupBy("company", "holder").agg(F.max("equity").alias("equity"), F.max("vote").alias("vote"))
    both = both.join(unresolved.groupBy("holder").agg(F.max("opaque").alias("opaque")), "holder", "left")
    e, under = F.col("equity"), F.col("equity") < share("0.5")
    most = people.groupBy("company").agg(F.max("directorships").alias("most"))
    each = both.groupBy("company").agg(
        F.count("equity").alias("owners"),
        F.coalesce(F.max(F.col("vote") - F.coalesce("equity", share("0")) >= F.lit(S.MIN_DIVERGENCE)), F.lit(False)).alias("voting"),
        F.coalesce(F.max(F.col("opaque") & (e > share("0.5"))), F.lit(False)).alias("unresolvable"),
        F.coalesce(F.max(~e.isin(*map(share, S.ROUND_SHARES))), F.lit(False)).alias("unusual"),
        F.count_if(under).alias("n_under"),
        F.sum(F.when(under, e)).alias("under"),
        F.sum("equity").alias("total"),
    )
    rows = each.filter("owners > 0").join(most, "company", "left")
    values = (
        F.coalesce(F.col("most") >= S.NOMINEE_DIRECTORSHIPS, F.lit(False)),
        F.col("voting"),
        F.col("unresolvable"),
        F.col("unusual"),
        F.coalesce((F.col("n_under") >= 2) & (F.col("under") > share("0.5")), F.lit(False)),
        F.col("total") < share("0.9999"),
    )
    return rows.select("company", "owners", *(v.alias(name) for name, v in zip(PROFILE, values, strict=True)))


def stratified_rates(profile: DataFrame) -> DataFrame:
    """stratum (owners, six for more), n and the share of companies for which each boolean of ``PROFILE`` holds."""
    return profile.groupBy(owner_band(F.col("owners")).alias("stratum")).agg(F.count(F.lit(1)).alias("n"), *(F.avg(F.col(p).cast("int")).alias(p) for p in PROFILE))


def bunching_ratios(shares: DataFrame, thresholds: tuple = S.THRESHOLDS) -> DataFrame:
    """threshold, below2, below1, at, above1, ratio: shares around every legal threshold, in one pass; the ratio of below to above is null where none is above."""
    s, one, two = F.col("share"), F.lit("0.01").cast(S.SHARE), F.lit("0.02").cast(S.SHARE)
    each = shares.select("share", F.explode(F.array(*(F.lit(t).cast(S.SHARE) for t in thresholds))).alias("threshold"))
    t = F.col("threshold")
    n = {"below2": (s >= t - two) & (s < t), "below1": (s >= t - one) & (s < t), "at": s == t, "above1": (s > t) & (s <= t + one)}
    counted = each.groupBy("threshold").agg(*(F.count_if(c).alias(k) for k, c in n.items()))
    return counted.withColumn("ratio", F.try_divide(F.col("below1").cast("double"), F.col("above1").cast("double")))


def common_values(shares: DataFrame, most: int = 12) -> DataFrame:
    """share, n, rate: the most common shares, ties by value."""
    counted = shares.groupBy("share").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("__all"))  # one row
    rows = counted.crossJoin(F.broadcast(total)).select("share", "n", (F.col("n") / F.col("__all")).alias("rate"))
    return rows.orderBy(F.col("n").desc(), "share").limit(most)


def roles_per_person(roles: DataFrame) -> DataFrame:
    """n_roles, people, cumulative: how many people hold that many roles, and which share holds no more."""
    each = roles.groupBy("person").agg(F.count(F.lit(1)).alias("n_roles")).groupBy("n_roles").agg(F.count(F.lit(1)).alias("people"))
    # one row for each number of roles
    up = Window.orderBy("n_roles")
    return each.select("n_roles", "people", (F.sum("people").over(up) / F.sum("people").over(Window.partitionBy())).alias("cumulative"))
