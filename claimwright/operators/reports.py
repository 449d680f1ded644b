"""Counts and orders over research records, logs and cohorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright import schemas as S


def undated(claims: DataFrame) -> DataFrame:
    """predicate, n: claims without any period whose predicate asks for one."""
    return claims.filter(F.col("valid_from").isNull() & F.col("valid_to").isNull() & ~F.col("predicate").isin(*S.UNDATED)).groupBy("predicate").agg(F.count(F.lit(1)).alias("n"))


def most_common(rows: DataFrame, value: str, seq: str, n: int) -> DataFrame:
    """rank, value, n of the ``n`` most frequent values; equal counts in the order of first appearance."""
    counts = rows.groupBy(F.col(value).alias("value")).agg(F.count(F.lit(1)).alias("n"), F.min(seq).alias("first"))
    top = counts.orderBy(F.col("n").desc(), "first").limit(n)  # a report of n rows
    return top.select(F.row_number().over(Window.orderBy(F.col("n").desc(), "first")).alias("rank"), "value", "n")


def index_order(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Rows by name, blank ones last, then by key."""
    blank = F.coalesce(F.trim(name), F.lit("")) == ""
    return rows.orderBy(blank, name, key)


def last_time(log: DataFrame, tools: DataFrame, default: str) -> DataFrame:
    """tool, last: when each tool was last logged, else the default."""
    last = log.groupBy("tool").agg(F.max_by("at", F.struct("at", "seq")).alias("last"))
    return tools.join(last, "tool", "left").select("tool", F.coalesce("last", F.lit(default).cast("timestamp")).alias("last"))


def packet_reviews(reviews: DataFrame) -> DataFrame:
    """Every review of every packet with its place, newest first; none is dropped."""
    return reviews.withColumn("place", F.row_number().over(Window.partitionBy("packet").orderBy(F.col("at").desc(), F.col("seq").desc())))


def claims_with_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, label, subject, object of claim nodes; a missing end is null."""
    ends = edges.filter("kind IN ('subject', 'object')").groupBy(F.col("src").alias("id")).agg(F.max(F.when(F.col("kind") == "subject", F.col("dst"))).alias("subject"), F.max(F.when(F.col("kind") == "object", F.col("dst"))).alias("object"))
    return nodes.filter("kind = 'claim'").select("id", "label").join(ends, "id", "left")


def speaker_labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """report, speaker: the report's own label and that of who made it."""
    by = edges.filter("kind = 'by'").select(F.col("src").alias("report"), F.col("dst").alias("who"))
    label = nodes.select("id", "label")
    named = by.join(label.withColumnsRenamed({"id": "who", "label": "speaker"}), "who").join(label.withColumnsRenamed({"id": "report", "label": "verb"}), "report")
    return named.select("report", F.concat(F.col("speaker"), F.lit(" ("), F.col("verb"), F.lit(")")).alias("speaker"))


def neighbours(edges: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, src, kind, dst: relation edges that touch an entity, each once."""
    rel = edges.filter(F.col("kind").startswith("rel:"))
    touching = rel.select(F.explode(F.array_distinct(F.array("src", "dst"))).alias("entity"), "src", "kind", "dst")
    return touching.join(entities.select("entity"), "entity", "left_semi")


def compared(statements: DataFrame) -> DataFrame:
    """subject, relation, sources, origins, rests_on, values, rows: what several sources say of one thing; only clean or reviewed ones count."""
    counted = statements.filter("status IN ('clean', 'reviewed')")
    each = counted.groupBy("subject", "relation").agg(
        F.count_distinct("source").alias("sources"),
        # a source without a declared origin is one of its own
        F.count_distinct(F.coalesce("origin", F.concat(F.lit("source:"), F.col("source").cast("string")))).alias("origins"),
        F.count_distinct("evidence").alias("rests_on"),
        F.count_distinct("value").alias("values"),
        F.count(F.lit(1)).alias("rows"),
    )
    return each.filter("sources > 1")


def workspace_status(statements: DataFrame) -> DataFrame:
    """status, n, sources: statements by review status."""
    return statements.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("source").alias("sources"))


def scored(results: DataFrame, by: str) -> DataFrame:
    """Counts of passed and failed cases, false accept and reject rates; cases nobody assessed stay apart."""
    assessed = F.col("verdict").isNotNull()
    accept, good = F.col("verdict") == "accept", F.col("supported")
    each = results.groupBy(by).agg(
        F.count_if(assessed & (accept == good)).alias("passed"),
        F.count_if(assessed & (accept != good)).alias("failed"),
        F.count_if(assessed & accept & ~good).alias("false_accepts"),
        F.count_if(assessed & ~accept & good).alias("false_rejects"),
        F.count_if(assessed & ~good).alias("bad"),
        F.count_if(assessed & good).alias("good"),
        F.count_if(~assessed).alias("unassessed"),
    )
    rate = lambda a, n: F.try_divide(F.col(a).cast("double"), F.col(n).cast("double"))
    return each.select(by, "passed", "failed", "unassessed", rate("false_accepts", "bad").alias("false_accept_rate"), rate("false_rejects", "good").alias("false_reject_rate"))


def contradiction_rates(pairs: DataFrame, companies: DataFrame) -> DataFrame:
    """kind, companies, total, of: how many companies have a contradiction of a kind, and how many there are."""
    n = companies.select(F.count_distinct("company").alias("of"))
    return pairs.groupBy("kind").agg(F.count_distinct("company").alias("companies"), F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(n))  # one row


def ages_compared(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), "unknown").when(a < b, "before").when(a > b, "after").otherwise("same")


def dual_countries(works: DataFrame) -> DataFrame:
    """work, n_countries, countries: works whose authors state more than one country."""
    each = works.filter("country IS NOT NULL").groupBy("work").agg(F.array_sort(F.collect_set("country")).alias("countries"))
    return each.filter(F.size("countries") > 1).select("work", F.size("countries").cast("long").alias("n_countries"), F.array_join("countries", ",").alias("countries"))


def author_candidates(works: DataFrame) -> DataFrame:
    """norm, author, works, affiliations: the authors that share a normal name: candidates, never one identity."""
    return works.groupBy("norm", "author").agg(F.count_distinct("work").alias("works"), F.count_distinct("affiliation").alias("affiliations"))


def jurisdictions(records: DataFrame, watched: tuple[str, ...]) -> DataFrame:
    """arm, domains, several, watched, rate: by arm, domains with more than one country, and with a watched one."""
    each = records.filter("country IS NOT NULL").groupBy("arm", "domain").agg(F.count_distinct("country").alias("n"), F.max(F.col("country").isin(*watched)).alias("hit"))
    arm = each.groupBy("arm").agg(F.count(F.lit(1)).alias("domains"), F.count_if(F.col("n") > 1).alias("several"), F.count_if("hit").alias("watched"))
    return arm.withColumn("rate", F.col("watched").cast("double") / F.col("domains").cast("double"))


def first_pages(pages: DataFrame, tag: str) -> DataFrame:
    """The first page of each resource with a tag."""
    w = Window.partitionBy("resource_id").orderBy("page", "seq")
    return pages.filter(F.col("tag") == tag).withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def cohort(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """company, arm, page: companies of labelled pages in page order, each where it comes first; ``pages``: (page, tag, companies array)."""
    rows = pages.join(labels, "tag").select("arm", "page", F.posexplode("companies").alias("pos", "company"))
    return rows.groupBy("company").agg(F.min(F.struct("page", "pos", "arm")).alias("x")).select("company", F.col("x.arm").alias("arm"), F.col("x.page").alias("page"))


def blob_text(log: DataFrame, blobs: DataFrame) -> DataFrame:
    """The log with its stored bodies by hash, whole; a body that is missing is null."""
    return log.join(blobs.select("content_hash", "body"), "content_hash", "left")


def blob_preview(log: DataFrame, blobs: DataFrame, most: int = 200_000) -> DataFrame:
    """``blob_text`` cut to its first characters, with ``whole``: whether that is all."""
    cut = blobs.select("content_hash", F.substring("body", 1, most).alias("body"), (F.length("body") <= most).alias("whole"))
    return log.join(cut, "content_hash", "left")


def blob_json(log: DataFrame, blobs: DataFrame, schema: str) -> DataFrame:
    """The log with its stored bodies parsed by a schema; null where a body is missing or is no such JSON."""
    return blob_text(log, blobs).withColumn("body", F.from_json("body", schema))


def licensed(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with ``quotable``: whether their source's licence is open or asks for attribution only; an unknown source is not."""
    known = registry.select("source", F.upper("licence").isin("OPEN", "ATTRIBUTION").alias("__ok"))
    return rows.join(known, "source", "left").withColumn("quotable", F.coalesce("__ok", F.lit(False))).drop("__ok")


def agenda_order(items: DataFrame) -> DataFrame:
    """Cheapest first, then by key and subject."""
    return items.orderBy("cost", "key", "subject")


def predicate_vector(results: DataFrame, predicates: tuple[str, ...], key: str = "company") -> DataFrame:
    """One row for each company with a boolean for each predicate; null where it was not evaluated."""
    fired = lambda p: F.max(F.when(F.col("predicate") == p, F.col("value") == S.TRUE))
    return results.groupBy(key).agg(*(fired(p).alias(p) for p in predicates))


def arms_compared(results: DataFrame) -> DataFrame:
    """predicate, arm, evaluable, n_true, unknowable_rate: the arms of a test side by side; what is unknowable has a rate of its own."""
    n = lambda v: F.count_if(F.col("value") == v)
    each = results.groupBy("predicate", "arm").agg(n(S.TRUE).alias("n_true"), n(S.UNKNOWABLE).alias("n_unknowable"), F.count(F.lit(1)).alias("n"))
    return each.select("predicate", "arm", (F.col("n") - F.col("n_unknowable")).alias("evaluable"), "n_true", (F.col("n_unknowable").cast("double") / F.col("n")).alias("unknowable_rate"))


def gaps(subjects: DataFrame, facts: DataFrame, expectations: DataFrame, asked: DataFrame, rates: DataFrame) -> DataFrame:
    """subject, expectation, closable, base_rate: where an expectation is triggered and its check is not there.

    ``facts``: (subject, fact); ``expectations``: (expectation, trigger, check,
    source).  A gap is closable while nobody has asked its source (``asked``:
    subject, source); ``rates`` says how often it occurs.
    """
    has = facts.select("subject", "fact").distinct()
    few = F.broadcast(expectations)  # a table of rules
    due = subjects.select("subject").join(has.withColumnRenamed("fact", "trigger"), "subject").join(few, "trigger")
    met = has.select("subject", F.col("fact").alias("check"))
    open_ = due.join(met, ["subject", "check"], "left_anti")
    known = asked.select("subject", "source").distinct().withColumn("__asked", F.lit(True))
    rows = open_.join(known, ["subject", "source"], "left").join(F.broadcast(rates), "expectation", "left")
    return rows.select("subject", "expectation", F.col("__asked").isNull().alias("closable"), "base_rate")
