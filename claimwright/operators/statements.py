"""Checks of statements against the passages they were read from."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from claimwright.functions.scalars import normal_text
from claimwright.operators.likeness import close_ids  # noqa: F401  nearest known ids

#: How far a passage reaches around its anchor, and how far it is moved to a sentence's end.
AROUND, SNAP = 600, 400


@F.pandas_udf(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))
def located_words(texts: pd.Series, words: pd.Series) -> pd.DataFrame:
    """Offsets of words in a text, read as quotes are: white space collapsed, case folded, hyphenated line breaks joined; null if absent."""
    import re

    def one(text, wanted):
        target = " ".join((wanted or "").replace("-\n", "").split()).casefold()
        if not text or not target:
            return None, None
        folded, origin = [], []
        # line breaks after hyphens vanish, runs of white space are one space
        for m in re.finditer(r"-\n|\s+|[^\s-]+|-", text):
            piece = m.group()
            if piece == "-\n":
                continue
            if piece.isspace():
                if folded and folded[-1] != " ":
                    folded.append(" ")
                    origin.append(m.start())
                continue
            for k, c in enumerate(piece):
                for f in c.casefold():
                    folded.append(f)
                    origin.append(m.start() + k)
        at = "".join(folded).find(target)
        return (None, None) if at < 0 else (origin[at], origin[at + len(target) - 1] + 1)

    return pd.DataFrame([one(t, w) for t, w in zip(texts, words)], columns=["start", "end"]).astype("Int32")


def cut_passage(text: Column, start: Column, end: Column, around: int = AROUND, snap: int = SNAP) -> Column:
    """struct<start, end>: ``around`` characters on both sides, each moved outwards to the nearest sentence end within ``snap``."""
    low, high = F.greatest(F.lit(0), start - around), F.least(F.length(text), end + around)
    before = F.substr(text, F.greatest(F.lit(0), low - snap) + 1, low - F.greatest(F.lit(0), low - snap))
    after = F.substr(text, high + 1, F.lit(snap))
    # from the last sentence end before, up to the first one after
    lead = F.length(F.regexp_extract(before, r"(?s)^.*[.!?]\s+(.*)$", 1))
    lead = F.when(before.rlike(r"(?s)[.!?]\s"), lead).otherwise(F.lit(0))
    tail = F.length(F.regexp_extract(after, r"(?s)^(.*?[.!?])(?:\s|$)", 1))
    return F.struct((low - lead).alias("start"), (high + tail).alias("end"))


# Identifier schemes that mean the same thing everywhere, and ids that mean something in one source only.
RIGID = r"^(cvr:\d{8}|lei:[A-Z0-9]{20}|doi:10\.\d{4,9}/\S+|arxiv:\d{4}\.\d{4,5}(v\d+)?|model:[a-z0-9][a-z0-9._-]*-\d[\w.-]*|fixture:[A-Za-z0-9_-]+)$"
LOCAL = r"^local:([^#\s]+)#([a-z0-9]+([.-][a-z0-9]+)*)$"


def id_defect(ident: Column, source: Column, passage: Column) -> Column:
    """Why an identifier can't be used with a passage; null if it can.  A value must stand there as a token of its own."""
    text = F.lower(passage)
    slug = F.regexp_extract(ident, LOCAL, 2)
    words = F.concat(F.lit(" "), F.regexp_replace(text, "[^0-9a-z]+", " "), F.lit(" "))
    has = lambda w: F.contains(words, F.concat(F.lit(" "), w, F.lit(" ")))
    local_there = F.forall(F.split(slug, "[.-]"), has) | has(F.regexp_replace(slug, "[.-]", ""))
    value = F.lower(F.regexp_replace(ident, "^[^:]*:", ""))
    # every place of the value, told by what stands on both sides
    parts = F.split(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(r"\Q"), value, F.lit(r"\E")), -1)
    edge = F.transform(parts, lambda p, i: F.struct(p.alias("left"), F.get(parts, i + 1).alias("right")))
    whole = F.exists(edge, lambda e: e["right"].isNotNull() & ~e["left"].rlike("[0-9a-z]$") & ~e["right"].rlike("^[0-9a-z]"))
    fixture = ident.startswith("fixture:") & ~source.startswith("fixture:")
    return (
        F.when(ident.rlike(LOCAL), F.when(F.regexp_extract(ident, LOCAL, 1) != source, "local_id_wrong_source").when(~local_there, "local_id_not_in_passage"))
        .when(ident == source, None)
        .when(~ident.rlike(RIGID) | fixture, "not_rigid")
        .when(~F.coalesce(whole, F.lit(False)), "id_not_in_passage")
    )


# Fixed value: what may begin a sentence, in folded text.
OPENS = '[a-zæøåäöü0-9"“(]'


def _let(value: Column, use) -> Column:
    """``use`` of a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def context_of(text: Column, q: Column) -> Column:
    """struct(before, after) in normal forms: the words of the quote's own sentence on both sides of it; '' if the quote is not there."""
    none = F.struct(F.lit("").alias("before"), F.lit("").alias("after"))

    def parts(x: Column) -> Column:
        # a sentence begins behind an end mark and white space; the quote's own first letter may begin one
        lead = F.length(F.regexp_extract(x["head"], rf"(?s)^(.*[.!?]\s+){OPENS}", 1))
        before = F.substr(x["head"], lead + 1, F.length(x["head"]) - 1 - lead)
        stop = F.regexp_extract(x["tail"], rf"(?s)^(.*?[.!?]\s+){OPENS}", 1)
        after = F.substr(F.when(stop != "", stop).otherwise(x["tail"]), F.lit(2), F.length(x["tail"]))
        return F.struct(before.alias("before"), after.alias("after"))

    def around(y: Column) -> Column:
        at = y["at"]
        pieces = F.struct(F.substr(y["text"], F.lit(1), at).alias("head"), F.substr(y["text"], at - 1 + F.length(y["q"]), F.length(y["text"])).alias("tail"))
        return F.when((at >= 1) & (y["q"] != ""), _let(pieces, parts)).otherwise(none)

    return _let(F.struct(text.alias("text"), q.alias("q"), F.instr(text, q).alias("at")), around)


def sentence_context(passage: Column, quote: Column) -> tuple[Column, Column]:
    """The words of the quote's own sentence before it and after it, in normal form; '' if the quote is not there."""
    found = _let(F.struct(normal_text(passage).alias("t"), normal_text(quote).alias("q")), lambda x: context_of(x["t"], x["q"]))
    return found["before"], found["after"]


# Words of a label that name nobody.
FILLERS = ("the", "that", "this", "from", "with", "their", "and", "for", "its")


def label_words(label: Column) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(label), F.lit(r"[\w-]{3,}"), F.lit(0)), lambda w: ~w.isin(*FILLERS))


def _spaced(text: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"\W+", " "), F.lit(" "))


def named_in(label: Column, text: Column) -> Column:
    """Whether some content word of a label stands in a text."""
    spaced = _spaced(text)
    return F.exists(label_words(label), lambda w: F.contains(spaced, _spaced(w)))


def phrase_in(label: Column, text: Column) -> Column:
    """Whether all content words stand in a text, and the first three in order, with at most three words between."""
    words, spaced = label_words(label), _spaced(text)
    near = F.array_join(F.transform(F.slice(words, 1, 3), lambda w: F.btrim(_spaced(w))), r" (?:\w+ ){0,3}")
    return (F.size(words) > 0) & F.forall(words, lambda w: F.contains(spaced, _spaced(w))) & F.rlike(spaced, F.concat(F.lit(" "), near, F.lit(" ")))


def allowed_years(text: Column, source_date: Column) -> Column:
    """Sorted years that a statement may carry: written as a year, in a quarter or half, the source's own, the year before where the text says so, and those of a decade."""
    plain = F.regexp_extract_all(text, F.lit(r"(?<![\d+]\s)(?<![\d+])\b(1\d\d\d|20\d\d)\b(?!\s?\d)"), F.lit(1))
    parts = F.regexp_extract_all(text, F.lit(r"\b[QH][1-4]\s?(1\d\d\d|20\d\d)\b"), F.lit(1))
    own = F.substring(source_date, 1, 4)
    before = F.when(text.rlike(r"(?i)\b(last|previous|past) year\b|\ba year ago\b") & own.isNotNull(), (own.cast("int") - 1).cast("string"))
    decades = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(r"\b(1[89]\d|20\d)0s\b"), F.lit(1)), lambda d: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda y: F.concat(d, y.cast("string")))))
    return F.array_sort(F.array_distinct(F.filter(F.concat(plain, parts, decades, F.array(own, before)), lambda y: y.isNotNull())))


def world_time(statements: DataFrame, passages: DataFrame, sources: DataFrame) -> DataFrame:
    """statement, basis, start, end: stated time, else the latest date of its sources as an upper bound, else open.

    ``statements``: (statement, start, end, passage), one row for each passage.
    """
    dated = statements.join(passages.select("passage", "source"), "passage", "left").join(sources.select("source", "published"), "source", "left")
    each = dated.groupBy("statement").agg(F.first("start").alias("start"), F.first("end").alias("end"), F.max("published").alias("latest"))
    stated = F.col("start").isNotNull() | F.col("end").isNotNull()
    basis = F.when(stated, "stated").when(F.col("latest").isNotNull(), "asserted").otherwise("open")
    return each.select("statement", basis.alias("basis"), "start", F.when(stated, F.col("end")).otherwise(F.col("latest")).alias("end"))


def states(words: Column, quote: Column) -> Column:
    """Whether an answer's words are the quote's: three or more of them, or all."""
    w, q = normal_text(F.coalesce(words, F.lit(""))), normal_text(quote)
    return (w != "") & F.contains(q, w) & ((F.size(F.split(w, " ")) >= 3) | (w == q))


def review_status(statements: DataFrame, answers: DataFrame) -> DataFrame:
    """statement, status: withdrawn, else clean (nothing to review), else reviewed by an answer whose words the quote has, else unreviewed.

    ``statements``: (statement, quote, n_items); ``answers``: (statement, decision, words).
    """
    both = statements.join(answers, "statement", "left")
    gone = F.max(F.coalesce(F.col("decision") == "withdrawn", F.lit(False)))
    held = F.max(F.coalesce((F.col("decision") == "stated") & states(F.col("words"), F.col("quote")), F.lit(False)))
    each = both.groupBy("statement").agg(F.first("n_items").alias("n_items"), gone.alias("gone"), held.alias("held"))
    return each.select("statement", F.when(F.col("gone"), "withdrawn").when(F.col("n_items") == 0, "clean").when(F.col("held"), "reviewed").otherwise("unreviewed").alias("status"))


def counting(records: DataFrame, reviews: DataFrame) -> DataFrame:
    """The records that count: an inherited one only where a review confirms it."""
    confirmed = reviews.filter("decision = 'confirmed'").select(F.col("record").alias("__id")).distinct()
    return records.join(confirmed, F.col("id") == F.col("__id"), "left").filter("NOT inherited OR __id IS NOT NULL").drop("__id")


def evidence_of(declared: DataFrame, acts: DataFrame, sources: DataFrame) -> DataFrame:
    """statement, evidence: distinct declared evidence in order of declaration, and the own check of a source that verifies."""
    first = declared.groupBy("statement", F.trim("evidence").alias("evidence")).agg(F.min("seq").alias("seq"))
    checks = acts.filter("act = 'verifies'").select("statement").distinct().join(sources.select("statement", "source"), "statement").select("statement", F.concat(F.lit("check:"), "source").alias("evidence"), F.lit(2**62).alias("seq"))
    order = Window.partitionBy("statement").orderBy("seq", "evidence")
    return first.unionByName(checks).withColumn("place", F.row_number().over(order)).select("statement", "place", "evidence")


def effective_act(reports: DataFrame, declared: DataFrame) -> DataFrame:
    """statement, act: the last declared act, else what the report chain says: inferred, endorses (own voice) or attributes (a nested speaker).

    ``reports``: (statement, depth, verb), outermost at depth 1.
    """
    last = declared.groupBy("statement").agg(F.max_by("act", "seq").alias("declared"))
    chain = reports.groupBy("statement").agg(F.count(F.lit(1)).alias("n"), F.min_by("verb", "depth").alias("verb"))
    read = F.when(F.col("verb") == "infers", "inferred").when(F.col("n") == 1, "endorses").otherwise("attributes")
    return chain.join(last, "statement", "left").select("statement", F.coalesce("declared", read).alias("act"))


def repeated_ids(records: DataFrame, ident: str = "id") -> DataFrame:
    """Ids that more than one record has."""
    return records.groupBy(ident).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def origin_warnings(sources: DataFrame) -> DataFrame:
    """outlet, n_groups, groups: outlets whose pages were declared to be of several origins."""
    declared = sources.filter("coalesce(trim(origin), '') <> '' AND coalesce(trim(basis), '') <> ''")
    # groups of one outlet are the declared names, few by nature
    each = declared.select("outlet", F.trim("origin").alias("origin")).distinct().groupBy("outlet").agg(F.array_sort(F.collect_list("origin")).alias("groups"))
    return each.filter(F.size("groups") > 1).select("outlet", F.size("groups").cast("long").alias("n_groups"), F.array_join("groups", ",").alias("groups"))


# Where a document's date may be stated, most trusted first.
DATE_BASES = ("json-ld datePublished", "citation meta", "jats pub-date", "record firstPublicationDate", "record pubYear", "meta tag", "arxiv", "pdf:creationdate")


def picked_date(candidates: DataFrame, key: str) -> DataFrame:
    """key, date, basis, conflict of dates (key, basis, pos, value) that a document states.

    The first of the most trusted basis counts.  A first of January beside
    another date of its year is that year, a coarse date takes the finest one
    that agrees with it, and dates that don't agree are a conflict.  An arXiv
    record also has its revisions' dates: those after its first month don't conflict.
    """
    # dates of one document are few
    raw = candidates.groupBy(key).agg(F.collect_list(F.struct("basis", "pos", "value")).alias("c"))
    values = F.array_distinct(F.transform("c", lambda x: x["value"]))
    padded = lambda v: v.endswith("-01-01") & F.exists(values, lambda w: (F.substring(w, 1, 4) == F.substring(v, 1, 4)) & (w != v))
    norm = lambda v: F.when(padded(v), F.substring(v, 1, 4)).otherwise(v)
    rank = F.array_position(F.array(*map(F.lit, DATE_BASES)), F.lit("arxiv"))
    order = lambda x: F.struct(F.array_position(F.array(*map(F.lit, DATE_BASES)), x["basis"]).alias("rank"), x["pos"].alias("pos"), norm(x["value"]).alias("value"))
    rows = raw.select(key, F.array_distinct(F.transform(values, norm)).alias("v"), F.array_sort(F.filter(F.transform("c", order), lambda o: o["rank"] > 0)).alias("o"))
    revised = F.get(F.filter("o", lambda o: o["rank"] == rank), F.lit(0))["value"]
    rows = rows.select(key, "o", F.substring(revised, 1, 7).alias("first"), "v")
    kept = F.when(F.col("first").isNull(), F.col("v")).otherwise(F.array_distinct(F.concat(F.filter("v", lambda x: F.substring(x, 1, 7) <= F.col("first")), F.array("first"))))
    fits = lambda a, b: F.substring(a, 1, 7).startswith(F.substring(b, 1, 7)) | F.substring(b, 1, 7).startswith(F.substring(a, 1, 7))
    rows = rows.select(key, F.get("o", F.lit(0)).alias("top"), kept.alias("v"))
    conflict = F.exists("v", lambda a: F.exists("v", lambda b: ~fits(a, b)))
    finest = F.aggregate(F.array_sort(F.filter("v", lambda x: x.startswith(F.col("top.value")))), F.lit(""), lambda best, x: F.when(F.length(x) > F.length(best), x).otherwise(best))
    basis = F.get(F.array(*map(F.lit, DATE_BASES)), (F.col("top.rank") - 1).cast("int"))
    return rows.select(key, F.when(F.col("top").isNotNull(), F.when(finest != "", finest).otherwise(F.col("top.value"))).alias("date"), F.coalesce(basis, F.lit("none")).alias("basis"), (F.col("top").isNotNull() & conflict).alias("conflict"))


def original_date(date: Column, words: Column, note: Column, text: Column) -> Column:
    """A declared date of the document that a source is a copy of, if three or more exact words of the source state its year; else null."""
    w = normal_text(F.coalesce(words, F.lit("")))
    good = date.rlike(r"^\d{4}(-\d{2}(-\d{2})?)?$") & (F.trim(F.coalesce(note, F.lit(""))) != "") & (F.size(F.split(w, " ")) >= 3) & F.contains(words, F.substring(date, 1, 4)) & F.contains(normal_text(text), w)
    return F.when(good, date)


def intake(atoms: DataFrame, held: DataFrame, ties: tuple[str, ...] = ()) -> DataFrame:
    """uid, outcome: refused for defects, a duplicate of one held or of an earlier one, else open or closed.

    Earlier is by ``seq`` and then by the columns ``ties``.
    """
    known = held.select(F.col("uid").alias("__uid")).distinct()
    first = F.row_number().over(Window.partitionBy("uid").orderBy("seq", *ties))
    rows = atoms.withColumn("__rn", first).join(known, F.col("uid") == F.col("__uid"), "left")
    outcome = F.when(F.col("defects") > 0, "refused").when(F.col("__uid").isNotNull() | (F.col("__rn") > 1), "duplicate").when(F.col("open") > 0, "open").otherwise("closed")
    return rows.select("uid", "seq", outcome.alias("outcome"))


def cached_verdicts(wanted: DataFrame, cache: DataFrame, keys: list[str], most_calls: int) -> DataFrame:
    """The wanted keys with their verdict from the cache; of the misses, the first ``most_calls`` in order are to be asked (``ask``), the rest wait."""
    rows = wanted.select(*keys).distinct().join(cache, keys, "left")
    budget = rows.filter("verdict IS NULL").orderBy(*keys).limit(most_calls).select(*keys).withColumn("ask", F.lit(True))  # a budget of calls
    return rows.join(budget, keys, "left").withColumn("ask", F.coalesce("ask", F.lit(False)))


def evidence_status(log: DataFrame, passages: DataFrame, allowed: tuple[str, ...]) -> DataFrame:
    """evidence, status, passage: valid declarations: an allowed status, a note, and at least three words that the passage holds."""
    both = log.filter(F.col("status").isin(*allowed) & (F.trim(F.coalesce("note", F.lit(""))) != "")).join(passages, "passage")
    w = normal_text(F.coalesce("words", F.lit("")))
    return both.filter((F.size(F.split(w, " ")) >= 3) & F.contains(normal_text(F.col("text")), w)).select("evidence", "status", "passage")


def attestations(rows: DataFrame, pairable: tuple[str, ...]) -> DataFrame:
    """Claims that a person attests: the quote must be in its excerpt and the predicate one that a register can be asked about."""
    good = rows.filter(F.contains(normal_text(F.col("excerpt")), normal_text(F.col("quote"))) & (normal_text(F.col("quote")) != "") & F.col("predicate").isin(*pairable))
    return good.select("subject", "predicate", "value", F.lit("self_declared").alias("tier"))


def observation_claims(rows: DataFrame) -> DataFrame:
    """subject, predicate, value, tier, place: an analyst's verdicts as claims, oldest first."""
    place = F.row_number().over(Window.partitionBy("subject").orderBy("at", "seq"))
    return rows.select("subject", F.lit("analyst_verdict").alias("predicate"), F.col("verdict").alias("value"), F.lit("analyst").alias("tier"), place.alias("place"))
