"""The second register: companies as CSV rows, holders as a JSON list in a field, to the same claims."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright import schemas as S
from claimwright.functions.scalars import day_of

HOLDERS = "array<struct<isiku_tyyp:string,eesnimi:string,nimi_arinimi:string,isikukood_registrikood:string,osaluse_protsent:string,algus_kpv:string,lopp_kpv:string>>"


def _claims(rows: DataFrame, predicate: str, subject: Column, obj: Column, start: Column, end: Column | None = None, share: Column | None = None) -> DataFrame:
    return rows.select(
        subject.alias("subject_key"),
        F.lit(predicate).alias("predicate"),
        obj.alias("object_repr"),
        start.alias("valid_from"),
        (F.lit(None).cast("date") if end is None else end).alias("valid_to"),
        (F.lit(None).cast(S.SHARE) if share is None else share).alias("share"),
    )


def company_claims(companies: DataFrame) -> DataFrame:
    """Name, state, form, founding and address of (code, name, status, status_text, legal_form, registered, address) rows."""
    c = companies.withColumn("__day", day_of(F.col("registered")))
    me, day, never = F.concat(F.lit("ee:"), "code"), F.col("__day"), F.lit(None).cast("date")
    given = lambda col: c.filter(F.coalesce(col, F.lit("")) != "")
    return reduce(
        DataFrame.unionByName,
        (
            _claims(c, "has_name", me, F.col("name"), day),
            _claims(c, "has_status", me, F.coalesce(F.when(F.col("status_text") != "", F.col("status_text")), "status"), day),
            _claims(given("legal_form"), "has_form", me, F.col("legal_form"), day),
            _claims(c.filter(day.isNotNull()), "founded_on", me, day.cast("string"), never),
            _claims(given("address"), "registered_at", me, F.concat(F.lit("ee-addr:"), F.lower("address")), day),
        ),
    )


def holders(companies: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """code and one row for each holder of the JSON list ``osanikud``; only wanted codes, if given."""
    rows = companies if wanted is None else companies.join(wanted.select("code").distinct(), "code", "left_semi")
    return rows.select("code", F.explode(F.from_json("osanikud", HOLDERS)).alias("h"))


def holder_key(h: Column) -> Column:
    """A registry code, else a name key, which shows that nothing resolved it."""
    code, name = F.coalesce(h["isikukood_registrikood"], F.lit("")), F.trim(F.concat_ws(" ", h["eesnimi"], h["nimi_arinimi"]))
    return F.when(code == "", F.concat(F.lit("name:"), F.lower(name))).when(h["isiku_tyyp"] == "J", F.concat(F.lit("ee:"), code)).otherwise(F.concat(F.lit("ee-person:"), code))


def holder_claims(rows: DataFrame) -> DataFrame:
    """Ownership claims: the holder is the subject, the company the object; a percentage that is left out is a null share."""
    h = F.col("h")
    some = rows.filter((F.coalesce(h["isikukood_registrikood"], F.lit("")) != "") | (F.trim(F.concat_ws(" ", h["eesnimi"], h["nimi_arinimi"])) != ""))
    share = (F.replace(h["osaluse_protsent"], F.lit(","), F.lit(".")).try_cast("decimal(12,6)") / F.lit(100)).cast(S.SHARE)
    return _claims(some, S.OWNS, holder_key(h), F.concat(F.lit("ee:"), "code"), day_of(h["algus_kpv"]), day_of(h["lopp_kpv"]), share)


def unfollowable(rows: DataFrame) -> DataFrame:
    """code, holder: holders that no register leads on from; they are reported, not dropped."""
    h = F.col("h")
    return rows.filter((h["isiku_tyyp"] != "J") | (F.coalesce(h["isikukood_registrikood"], F.lit("")) == "")).select("code", holder_key(h).alias("holder"))
