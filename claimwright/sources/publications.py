"""Author records, works and patent records (nested JSON) to claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTITUTION = "struct<id:string,ror:string,display_name:string,type:string,country_code:string>"
AUTHOR = f"struct<id:string,display_name:string,orcid:string,works_count:bigint,affiliations:array<struct<institution:{INSTITUTION},years:array<int>>>>"
WORK = f"struct<id:string,display_name:string,doi:string,type:string,publication_date:string,publication_year:int,authorships:array<struct<author:struct<id:string,display_name:string>,institutions:array<{INSTITUTION}>>>>"


def bare_id(url: Column) -> Column:
    """The last part of an identifier written as an address."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"([^/]*)/?$", 1)


def person_key(name: Column, author: Column) -> Column:
    return F.when(author != "", F.concat(F.lit("openalex:"), author)).otherwise(F.concat(F.lit("name:"), F.lower(name)))


def institution_key(i: Column) -> Column:
    ror = bare_id(i["ror"])
    return F.when(ror != "", F.concat(F.lit("ror:"), ror)).otherwise(F.concat(F.lit("openalex:"), bare_id(i["id"])))


def author_affiliations(documents: DataFrame, col: str = "json") -> DataFrame:
    """subject_key, object_key, country, valid_from, valid_to: a claim for each institution and year an author record states; of one record or a page of results."""
    both = F.from_json(F.col(col), f"results array<{AUTHOR}>, id string, display_name string, orcid string, works_count bigint, affiliations array<struct<institution:{INSTITUTION},years:array<int>>>")
    d = documents.select(both.alias("d"))
    one = F.array(F.struct("d.id", "d.display_name", "d.orcid", "d.works_count", "d.affiliations"))
    a = d.select(F.explode(F.coalesce("d.results", one)).alias("a")).filter("a.display_name <> ''")
    rows = a.select(person_key(F.col("a.display_name"), bare_id(F.col("a.id"))).alias("subject_key"), F.explode("a.affiliations").alias("f")).filter("f.institution.display_name <> ''")
    each = rows.select("subject_key", F.col("f.institution").alias("i"), F.explode_outer("f.years").alias("year"))
    return each.select("subject_key", institution_key(F.col("i")).alias("object_key"), F.col("i.country_code").alias("country"), F.make_date("year", F.lit(1), F.lit(1)).alias("valid_from"), F.make_date("year", F.lit(12), F.lit(31)).alias("valid_to"))


def work_claims(documents: DataFrame, author: str, col: str = "json") -> DataFrame:
    """subject_key, predicate, object_key, work, valid_from: the author's own affiliations as a work states them, and the people it was written with."""
    works = documents.select(F.explode(F.from_json(F.col(col), f"results array<{WORK}>")["results"]).alias("w"))
    day = F.coalesce(F.try_to_date(F.substring("w.publication_date", 1, 10), "yyyy-MM-dd"), F.make_date("w.publication_year", F.lit(1), F.lit(1)))
    own = F.get(F.filter("w.authorships", lambda a: bare_id(a["author"]["id"]) == author), F.lit(0))["author"]["display_name"]
    base = works.select(bare_id(F.col("w.id")).alias("work"), day.alias("valid_from"), person_key(F.coalesce(own, F.lit(author)), F.lit(author)).alias("subject_key"), F.explode("w.authorships").alias("a"))
    mine = bare_id(F.col("a.author.id")) == author
    claim = lambda predicate, key: F.struct(F.lit(predicate).alias("predicate"), key.alias("object_key"))
    stated = F.transform(F.filter("a.institutions", lambda i: i["display_name"] != ""), lambda i: claim("has_affiliation", institution_key(i)))
    name = F.col("a.author.display_name")
    other = F.array(claim("co_authored_with", person_key(name, bare_id(F.col("a.author.id")))))
    # all claims of an authorship are one array, so a page of results is parsed once
    each = base.select("subject_key", "work", "valid_from", F.inline(F.when(mine, stated).when(F.coalesce(name, F.lit("")) != "", other)))
    return each.select("subject_key", "predicate", "object_key", "work", "valid_from")


def clean_party(name: Column) -> Column:
    """A party's name without its country in brackets, white space collapsed, in capitals."""
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(name, r"\s*\[[A-Z]{2}\]\s*$", ""), r"[\s\u2002]+", " ")))


def party_country(name: Column) -> Column:
    return F.regexp_extract(name, r"\[([A-Z]{2})\]\s*$", 1)


def listed(json: Column, kind: str) -> Column:
    """A JSON value as a list of ``kind``: one that stands alone is a list of one."""
    text = F.trim(json)
    return F.from_json(F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), text, F.lit("]"))), f"array<{kind}>")


def patent_claims(documents: DataFrame, col: str = "json") -> DataFrame:
    """subject_key, predicate, object_key, valid_from, country: applicants and inventors of search results, each cleaned name once.

    A value may stand alone where a list has one member, and each scalar is
    wrapped as ``{"$": value}``.
    """
    at = lambda c, path: F.get_json_object(c, path)
    docs = documents.select(F.explode(listed(at(F.col(col), "$['ops:world-patent-data']['ops:biblio-search']['ops:search-result']['exchange-documents']"), "string")).alias("x"))
    bib = docs.select(at(F.coalesce(at(F.col("x"), "$['exchange-document']"), F.col("x")), "$['bibliographic-data']").alias("b"))
    ids = listed(at(F.col("b"), "$['publication-reference']['document-id']"), "string")
    kinds = F.transform(ids, lambda i: F.struct((at(i, "$['@document-id-type']") == "epodoc").alias("main"), at(i, "$['doc-number']['$']").alias("number"), F.concat_ws("", at(i, "$.country['$']"), at(i, "$['doc-number']['$']"), at(i, "$.kind['$']")).alias("other"), F.try_to_date(at(i, "$.date['$']"), "yyyyMMdd").alias("day")))
    p = bib.select("b", kinds.alias("k")).select("b", F.get(F.filter("k", lambda k: k["main"]), F.lit(0)).alias("e"), F.get("k", F.lit(0)).alias("f"))
    p = p.select("b", F.coalesce("e.number", "f.other").alias("number"), F.coalesce("e.day", "f.day").alias("day")).filter("number <> ''")
    out = None
    for group, tag, predicate in (("applicants", "applicant", "holds_patent_application"), ("inventors", "inventor", "named_as_inventor")):
        names = F.transform(listed(at(F.col("b"), f"$.parties.{group}.{tag}"), "string"), lambda a: at(a, f"$['{tag}-name'].name['$']"))
        each = p.select("number", "day", names.alias("names"))
        country = F.get(F.filter(F.transform("names", party_country), lambda c: c != ""), F.lit(0))
        rows = each.select("number", "day", F.coalesce(country, F.lit("")).alias("country"), F.explode(F.array_distinct(F.filter(F.transform("names", clean_party), lambda n: n != ""))).alias("name"))
        rows = rows.select(F.concat(F.lit("name:"), F.lower("name")).alias("subject_key"), F.lit(predicate).alias("predicate"), F.concat(F.lit("patent:"), "number").alias("object_key"), F.col("day").alias("valid_from"), "country")
        out = rows if out is None else out.unionByName(rows)
    return out


def transfers(events: DataFrame, markers: tuple[str, ...], exclusions: tuple[str, ...]) -> DataFrame:
    """publication, description, valid_from of events (publication, description, slots map<slot, struct<desc, value>>) that record a right changing hands.

    A marker must be in the description and no exclusion; the day is that of the
    first slot that is described as a date and holds one.
    """
    text = F.upper("description")
    has = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))
    slots = F.filter(F.map_entries("slots"), lambda e: e["key"].startswith("ops:L") & F.contains(F.upper(e["value"]["desc"]), F.lit("DATE")))
    days = F.filter(F.transform(F.array_sort(slots), lambda e: F.try_to_date(e["value"]["value"], "yyyyMMdd")), lambda d: d.isNotNull())
    return events.filter(has(markers) & ~has(exclusions)).select("publication", F.initcap(F.lower("description")).alias("description"), F.get(days, F.lit(0)).alias("valid_from"))
