"""Cap-table predicates: four-valued results from ownership and voting claims.

Inputs are claims with columns ``company``, ``holder``, ``share`` (exact
decimal or null), ``valid_from`` and ``valid_to``.  A predicate gives one row
(company, predicate, value, raw) for every company of ``companies``.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright import schemas as S
from claimwright.operators.temporal import has_begun, in_force, started_by


def per_holder(claims: DataFrame, on: date | str) -> DataFrame:
    """company, holder, share (largest filed), conflicted: holdings in force with a number."""
    rows = claims.filter(in_force(on)).filter(F.col("share").isNotNull())
    return rows.groupBy("company", "holder").agg(F.max("share").alias("share"), (F.min("share") < F.max("share")).alias("conflicted"))


def shares_by_holder(claims: DataFrame, on: date | str) -> DataFrame:
    """company, holder, shares: sorted filed values with their register."""
    rows = claims.filter(in_force(on)).filter(F.col("share").isNotNull())
    return rows.groupBy("company", "holder").agg(F.sort_array(F.collect_list(F.struct("share", "register"))).alias("shares"))


def _result(companies: DataFrame, facts: DataFrame, predicate: str, value: Column, raw: Column) -> DataFrame:
    return companies.join(facts, "company", "left").select("company", F.lit(predicate).alias("predicate"), value.alias("value"), raw.alias("raw"))


def voting_exceeds_equity(companies: DataFrame, owns: DataFrame, votes: DataFrame, on: date | str) -> DataFrame:
    equity = per_holder(owns, on).select("company", "holder", F.col("share").alias("equity"))
    voting = per_holder(votes, on).select("company", "holder", F.col("share").alias("votes"))
    # holders with equity only count as filed but cannot exceed it
    both = equity.join(voting, ["company", "holder"], "full_outer")
    gap = F.col("votes") - F.coalesce("equity", F.lit(0).cast(S.SHARE))
    facts = both.groupBy("company").agg(F.max(F.when(gap >= F.lit(S.MIN_DIVERGENCE), gap)).alias("gap"))
    value = F.when(F.col("__filed").isNull(), S.UNKNOWABLE).when(F.col("gap").isNotNull(), S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts.withColumn("__filed", F.lit(1)), "voting_exceeds_equity", value, F.col("gap"))


def ownership_residual(companies: DataFrame, owns: DataFrame, on: date | str) -> DataFrame:
    held = per_holder(owns, on).groupBy("company").agg(F.sum("share").cast(S.SHARE).alias("total"))
    bare = owns.filter(in_force(on)).filter(F.col("share").isNull()).groupBy("company").agg(F.count(F.lit(1)).alias("unquantified"))
    facts = held.join(bare, "company", "full_outer").withColumn("rest", F.lit(1).cast(S.SHARE) - F.coalesce("total", F.lit(0).cast(S.SHARE)))
    value = F.when(F.col("rest").isNull(), S.UNKNOWABLE).when(F.col("rest") < F.lit(S.MIN_DIVERGENCE), S.FALSE).otherwise(S.TRUE)
    return _result(companies, facts, "ownership_residual_unaccounted", value, F.col("rest"))


def below_threshold(companies: DataFrame, owns: DataFrame, on: date | str) -> DataFrame:
    """Holdings just under a legal threshold; raw is the tightest gap."""
    held = per_holder(owns, on)
    gaps = F.array(*(F.lit(t).cast(S.SHARE) - F.col("share") for t in S.THRESHOLDS))
    near = F.array_min(F.filter(gaps, lambda g: (g > 0) & (g <= F.lit(S.BUNCHING_WINDOW))))
    facts = held.withColumn("gap", near).groupBy("company").agg(F.min("gap").alias("gap"), F.lit(1).alias("filed"))
    value = F.when(F.col("filed").isNull(), S.UNKNOWABLE).when(F.col("gap").isNotNull(), S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts, "stake_just_below_threshold", value, F.col("gap"))


def subthreshold_aggregate(companies: DataFrame, owns: DataFrame, on: date | str) -> DataFrame:
    """Holders under a half that together pass it: never TRUE, since their association is not known."""
    half = F.lit("0.5").cast(S.SHARE)
    under = F.col("share") < half
    facts = per_holder(owns, on).groupBy("company").agg(F.coalesce(F.sum(F.when(under, F.col("share"))), F.lit(0)).cast(S.SHARE).alias("total"), F.count_if(under).alias("n"))
    value = F.when(F.col("n").isNull(), S.UNKNOWABLE).when((F.col("n") >= 2) & (F.col("total") > half), S.UNKNOWN).otherwise(S.FALSE)
    return _result(companies, facts, "subthreshold_aggregate_over_50", value, F.col("total"))


def unusual_percentage(companies: DataFrame, owns: DataFrame, on: date | str) -> DataFrame:
    odd = ~F.col("share").isin(*(F.lit(s).cast(S.SHARE) for s in S.ROUND_SHARES))
    facts = per_holder(owns, on).groupBy("company").agg(F.count_if(odd).alias("n"))
    value = F.when(F.col("n").isNull(), S.UNKNOWABLE).when(F.col("n") > 0, S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts, "unusual_ownership_percentage", value, F.col("n").cast(S.SHARE))


def majority_unresolvable(companies: DataFrame, owns: DataFrame, on: date | str, opaque: Column) -> DataFrame:
    """A holder that no register can resolve, with more than a half."""
    hit = opaque & (F.col("share") > F.lit("0.5").cast(S.SHARE))
    facts = per_holder(owns, on).groupBy("company").agg(F.max(F.when(hit, F.col("share"))).alias("top"), F.lit(1).alias("filed"))
    value = F.when(F.col("filed").isNull(), S.UNKNOWABLE).when(F.col("top").isNotNull(), S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts, "majority_owner_unresolvable", value, F.col("top"))


def ownership_events(companies: DataFrame, owns: DataFrame, on: date | str) -> DataFrame:
    """More than one day on which a holding began."""
    facts = started_by(owns, on).groupBy("company").agg(F.count_distinct("valid_from").alias("n"))
    value = F.when(F.col("n").isNull(), S.UNKNOWABLE).when(F.col("n") > 1, S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts, "ownership_register_events", value, F.col("n").cast(S.SHARE))


def share_predicates(companies: DataFrame, owns: DataFrame, votes: DataFrame, on: date | str, opaque: Column) -> DataFrame:
    """Five predicates of the cap table at once: equity and votes are gone through once.

    The rows are those of ``voting_exceeds_equity``, ``ownership_residual``,
    ``subthreshold_aggregate``, ``ownership_events`` and ``majority_unresolvable``.
    """
    dates, none = ("company", "holder", "valid_from", "valid_to"), F.lit(None).cast(S.SHARE)
    filed = owns.select(*dates, "share", none.alias("votes"), F.lit(True).alias("is_equity"))
    voted = votes.select(*dates, none.alias("share"), F.col("share").alias("votes"), F.lit(False).alias("is_equity"))
    return _five(companies, filed.unionByName(voted), on, opaque)


def holding_predicates(companies: DataFrame, holdings: DataFrame, on: date | str, opaque: Column) -> DataFrame:
    """``share_predicates`` of holdings that have ``share`` and ``votes`` in one row; where they are dealt by company they stay as they are."""
    return _five(companies, holdings.withColumn("is_equity", F.lit(True)), on, opaque)


def _five(companies: DataFrame, both: DataFrame, on: date | str, opaque: Column) -> DataFrame:
    live, equity = in_force(on), F.col("is_equity")
    each = both.groupBy("company", "holder").agg(
        F.max(F.when(live, F.col("share"))).alias("equity"),
        F.max(F.when(live, F.col("votes"))).alias("votes"),
        F.count_if(live & equity & F.col("share").isNull()).alias("bare"),
        F.collect_set(F.when(has_begun(on) & equity, F.col("valid_from"))).alias("days"),
    )
    zero, half = F.lit(0).cast(S.SHARE), F.lit("0.5").cast(S.SHARE)
    gap = F.col("votes") - F.coalesce("equity", zero)
    under = F.col("equity") < half
    facts = each.groupBy("company").agg(
        F.max(F.when(gap >= F.lit(S.MIN_DIVERGENCE), gap)).alias("gap"),
        F.count(F.coalesce("equity", "votes")).alias("filed"),
        F.sum("equity").cast(S.SHARE).alias("total"),
        F.sum("bare").alias("bare"),
        F.count("equity").alias("holders"),
        F.count_if(under).alias("n_under"),
        F.coalesce(F.sum(F.when(under, F.col("equity"))), zero).cast(S.SHARE).alias("under"),
        F.max(F.when(opaque & (F.col("equity") > half), F.col("equity"))).alias("top"),
        F.size(F.array_distinct(F.flatten(F.collect_list("days")))).alias("n_days"),
    )
    rows = companies.join(facts, "company", "left")
    none = lambda c: F.coalesce(F.col(c), F.lit(0)) == 0
    rest = F.when(~none("holders") | ~none("bare"), F.lit(1).cast(S.SHARE) - F.coalesce("total", zero))
    yes = lambda c: F.when(c, S.TRUE).otherwise(S.FALSE)
    results = (
        ("voting_exceeds_equity", F.when(none("filed"), S.UNKNOWABLE).otherwise(yes(F.col("gap").isNotNull())), F.col("gap")),
        ("ownership_residual_unaccounted", F.when(rest.isNull(), S.UNKNOWABLE).otherwise(yes(rest >= F.lit(S.MIN_DIVERGENCE))), rest),
        ("subthreshold_aggregate_over_50", F.when(none("holders"), S.UNKNOWABLE).when((F.col("n_under") >= 2) & (F.col("under") > half), S.UNKNOWN).otherwise(S.FALSE), F.when(~none("holders"), F.col("under"))),
        ("ownership_register_events", F.when(none("n_days"), S.UNKNOWABLE).otherwise(yes(F.col("n_days") > 1)), F.when(~none("n_days"), F.col("n_days"))),
        ("majority_owner_unresolvable", F.when(none("holders"), S.UNKNOWABLE).otherwise(yes(F.col("top").isNotNull())), F.col("top")),
    )
    stacked = F.array(*(F.struct(F.lit(n).alias("predicate"), v.alias("value"), r.cast(S.SHARE).alias("raw")) for n, v, r in results))
    return rows.select("company", F.explode(stacked).alias("x")).select("company", "x.*")


def same_day_changes(companies: DataFrame, owns: DataFrame, capital: DataFrame, on: date | str) -> DataFrame:
    """Days on which both capital and ownership changed."""
    days = lambda rows: started_by(rows, on).select("company", "valid_from").distinct()
    both = days(owns).intersect(days(capital)).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    filed = days(capital).select("company").distinct().withColumn("filed", F.lit(1))
    facts = filed.join(both, "company", "left")
    value = F.when(F.col("filed").isNull(), S.UNKNOWABLE).when(F.col("n") > 0, S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts, "capital_change_same_day_as_ownership", value, F.col("n").cast(S.SHARE))


def nominee_density(companies: DataFrame, roles: DataFrame, index: DataFrame, on: date | str) -> DataFrame:
    """People of the company by how many companies they direct; infrastructure left out.

    UNKNOWN if none of them is in the index.
    """
    people = roles.filter(in_force(on)).select("company", "person").distinct()
    known = people.join(index, "person", "left")
    usable = F.col("directorships") < S.INFRASTRUCTURE_DIRECTORSHIPS
    facts = known.groupBy("company").agg(F.max(F.when(usable, F.col("directorships"))).alias("most"), F.count("directorships").alias("found"))
    value = F.when(F.col("found").isNull(), S.UNKNOWABLE).when(F.col("most").isNull(), S.UNKNOWN).when(F.col("most") >= S.NOMINEE_DIRECTORSHIPS, S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts, "nominee_density", value, F.col("most").cast(S.SHARE))


def latest_is(companies: DataFrame, values: DataFrame, on: date | str, predicate: str, wanted: tuple[str, ...], missing: str = S.UNKNOWABLE) -> DataFrame:
    """Whether the newest value in force (company, value, valid_from, valid_to) is one of those wanted."""
    newest = values.filter(in_force(on)).groupBy("company").agg(F.max_by("value", F.struct(F.coalesce("valid_from", F.lit("0001-01-01").cast("date")), F.col("value"))).alias("newest"))
    value = F.when(F.col("newest").isNull(), missing).when(F.col("newest").isin(*wanted), S.TRUE).otherwise(S.FALSE)
    return _result(companies, newest, predicate, value, F.lit(None).cast(S.SHARE))


def versions_changed(companies: DataFrame, values: DataFrame, on: date | str, predicate: str) -> DataFrame:
    """At least two versions began by the day."""
    facts = started_by(values, on).groupBy("company").agg(F.count(F.lit(1)).alias("n"))
    value = F.when(F.col("n").isNull(), S.UNKNOWABLE).when(F.col("n") >= 2, S.TRUE).otherwise(S.FALSE)
    return _result(companies, facts, predicate, value, F.col("n").cast(S.SHARE))


def absent_filing(companies: DataFrame, filed: DataFrame, barred: DataFrame, predicate: str) -> DataFrame:
    """TRUE where nothing was filed; UNKNOWABLE where the duty does not apply."""
    facts = filed.select("company").distinct().withColumn("filed", F.lit(1)).join(barred.select("company").distinct().withColumn("barred", F.lit(1)), "company", "full_outer")
    value = F.when(F.col("barred").isNotNull(), S.UNKNOWABLE).when(F.col("filed").isNotNull(), S.FALSE).otherwise(S.TRUE)
    return _result(companies, facts, predicate, value, F.lit(None).cast(S.SHARE))


def governed(results: DataFrame) -> DataFrame:
    """Fired results with what their rule makes of them; those without a rule are ``ungoverned``."""
    rules = results.sparkSession.createDataFrame(list(S.RULES), "predicate string, value string, disposition string")
    fired = results.filter(~F.col("value").isin(S.FALSE, S.UNKNOWABLE))
    return fired.join(F.broadcast(rules), ["predicate", "value"], "left").withColumn("disposition", F.coalesce("disposition", F.lit("ungoverned")))


def screen_colour(dispositions: DataFrame, blocked: DataFrame, findings: DataFrame | None = None) -> DataFrame:
    """company, colour: red, else amber with a raised finding, grey where a material predicate is unknowable, else green.

    Red asks for an adjudicated finding (company, ground, authority, citation,
    hops) with all of its parts and about the company itself (no hops).
    """
    raised = dispositions.groupBy("company").agg(F.max((F.col("disposition") == "raise").cast("int")).alias("raised"))
    limits = blocked.groupBy("company").agg(F.max((F.col("value") == S.UNKNOWABLE).cast("int")).alias("limits"))
    rows = limits.join(raised, "company", "left").withColumn("red", F.lit(False))
    if findings is not None:
        proven = findings.filter("ground IS NOT NULL AND authority IS NOT NULL AND citation IS NOT NULL AND hops = 0").select("company", F.lit(True).alias("__red")).distinct()
        rows = rows.join(proven, "company", "left").withColumn("red", F.coalesce("__red", F.lit(False)))
    colour = F.when(F.col("red"), "red").when(F.coalesce("raised", F.lit(0)) == 1, "amber").when(F.col("limits") == 1, "grey").otherwise("green")
    return rows.select("company", colour.alias("colour"))
