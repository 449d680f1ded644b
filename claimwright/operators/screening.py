"""Names against a designation list, mandates, institutions, and who takes part in the outcome test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright import schemas as S
from claimwright.functions.names import designating, is_designation, name_variants, normal_name, party_kind


def name_index(targets: DataFrame) -> DataFrame:
    """norm, id, programmes: every spelling of every designated target once; ``targets``: (id, name, aliases, programmes)."""
    some = targets.filter(is_designation(F.col("programmes")))
    spelt = some.select("id", designating(F.col("programmes")).alias("programmes"), F.explode(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("spelling"))
    return spelt.withColumn("norm", normal_name("spelling")).filter("norm <> ''").select("norm", "id", "programmes").dropDuplicates(["norm", "id"])


def designated_holders(companies: DataFrame, holders: DataFrame, index: DataFrame | None) -> DataFrame:
    """company, value, reason, hit, target: whether a holder's name is on the list: a candidate, never a match.

    ``holders``: (company, holder, label).  No list, no holder or no name: UNKNOWABLE, with the reason.
    """
    if index is None:
        return companies.select("company", F.lit(S.UNKNOWABLE).alias("value"), F.lit("no designation list loaded").alias("reason"), *(F.lit(None).cast("string").alias(c) for c in ("hit", "target")))
    named = holders.withColumn("norm", normal_name(F.coalesce("label", F.lit(""))))
    found = named.filter("norm <> ''").join(index, "norm").groupBy("company", "holder").agg(F.min("id").alias("target"))
    first = found.groupBy("company").agg(F.min(F.struct("holder", "target")).alias("x"))
    counts = holders.groupBy("company").agg(F.count_distinct("holder").alias("n"), F.count_if(F.coalesce("label", F.lit("")) != "").alias("n_named"))
    all_ = companies.join(counts, "company", "left").join(first, "company", "left")
    value = F.when(F.col("n").isNull() | (F.col("n_named") == 0), S.UNKNOWABLE).when(F.col("x").isNotNull(), S.TRUE).otherwise(S.FALSE)
    reason = F.when(F.col("n").isNull(), "no holders filed").when(F.col("n_named") == 0, "no holder carries a name")
    return all_.select("company", value.alias("value"), reason.alias("reason"), F.col("x.holder").alias("hit"), F.col("x.target").alias("target"))


def institution_status(institutions: DataFrame, index: DataFrame, assessments: DataFrame) -> DataFrame:
    """institution, target (may ground a finding), assessment (never does): two records that stay apart."""
    norm = institutions.withColumn("norm", normal_name("institution"))
    hits = index.groupBy("norm").agg(F.min("id").alias("target"))
    rated = assessments.select(F.lower("name").alias("__name"), "assessment")
    return norm.join(hits, "norm", "left").join(rated, F.lower("institution") == F.col("__name"), "left").select("institution", "target", "assessment")


def mandate_active(on: Column, granted: Column, expires: Column, withdrawn: Column) -> Column:
    return F.coalesce(withdrawn.isNull() & (granted <= on) & (on <= expires), F.lit(False))


def mandate_permits(on: Column, source: Column, kind: Column, granted: Column, expires: Column, withdrawn: Column, sources: Column, kinds: Column) -> Column:
    return mandate_active(on, granted, expires, withdrawn) & F.coalesce(F.array_contains(sources, source) & F.array_contains(kinds, kind), F.lit(False))


def eligible(subjects: DataFrame, statuses: DataFrame, on: str = "as_of", normal: str = "NORMAL") -> DataFrame:
    """Subjects that existed at their date and had the normal status then, by the latest status that covers it.

    ``subjects``: (subject, founded, as_of); ``statuses``: (subject, status, valid_from, valid_to).
    """
    alive = subjects.filter(F.col("founded") <= F.col(on))
    covers = (F.col("valid_from") <= F.col(on)) & (F.col("valid_to").isNull() | (F.col("valid_to") >= F.col(on)))
    at = alive.select("subject", on).join(statuses, "subject").filter(covers).groupBy("subject", on).agg(F.max_by("status", F.struct("valid_from", "status")).alias("status"))
    return alive.join(at.filter(F.col("status") == normal).select("subject", on), ["subject", on], "left_semi")


def clean_controls(controls: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Controls without an adverse event at any time, and (kept, dropped) in one row."""
    ever = events.select("subject").distinct().withColumn("__event", F.lit(True))
    marked = controls.join(ever, "subject", "left")
    counts = marked.agg(F.count_if(F.col("__event").isNull()).alias("kept"), F.count_if("__event").alias("dropped"))
    return marked.filter("__event IS NULL").drop("__event"), counts


def group_evidence(parties: DataFrame, records: DataFrame, parents: DataFrame) -> DataFrame:
    """name, evidence, lei: what a list of legal entities says about a party; a miss says nothing.

    Estates and public bodies need no lookup.  Else the first form of the name
    that has records counts, an active record before others, then the least id.
    """
    kind = party_kind(F.col("name"))
    benign = kind.isin("estate", "public_body")
    forms = parties.filter(~benign).select("name", F.posexplode(name_variants(F.col("name"))).alias("place", "form"))
    met = forms.join(records.select(F.col("legal_name").alias("form"), "lei", "status"), "form")
    best = met.groupBy("name").agg(F.min(F.struct("place", (F.upper("status") != "ACTIVE").alias("idle"), "lei")).alias("x")).select("name", "x.idle", "x.lei")
    known = best.join(parents.select("lei").distinct().withColumn("parent", F.lit(True)), "lei", "left")
    evidence = F.when(benign, "benign_form").when(F.col("lei").isNull(), "no_lei").when(F.col("idle"), "lei_lapsed").when(F.col("parent"), "documented_group").otherwise("lei_only")
    return parties.join(known, "name", "left").select("name", evidence.alias("evidence"), "lei")
