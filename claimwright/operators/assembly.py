"""Verdicts, gates, imports, samples and screens put together from the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright import schemas as S
from claimwright.functions.names import domain_of


def support_flag(label: Column, tokens: Column, most: int = 512) -> Column:
    """What a model's answer about a statement asks for: nothing if it is entailed, a review if not; texts that are too long are not run."""
    return F.when(tokens > most, "not_run").when(label == "entailment", None).otherwise("review")


def hypothesis(statement: Column, speakers: Column) -> Column:
    """A statement as a question to a model: time phrases stripped, inner speakers (all but the outermost) before it."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(statement, r"(?i)\b(?:in|on|since|by)\s+\d{4}(?:-\d{2}){0,2}\b", ""), r"\s+", " "))
    inner = F.slice(speakers, 2, F.greatest(F.size(speakers) - 1, F.lit(0)))
    return F.when(F.size(inner) > 0, F.concat(F.array_join(F.transform(inner, lambda s: F.concat(s, F.lit(" says that "))), ""), bare)).otherwise(bare)


def eligible_atoms(checks: DataFrame) -> DataFrame:
    """uid, eligible: an atom whose every passage passes every check; a check that was not run is no pass."""
    return checks.groupBy("uid").agg(F.bool_and(F.coalesce("passed", F.lit(False))).alias("eligible"))


def expectations_met(outputs: DataFrame, expectations: DataFrame) -> DataFrame:
    """case, failed: what a case forbids or asks for and its output does or lacks.

    ``expectations``: (case, kind, value) with kind forbidden (no field holds
    it), polarity or speaker; ``outputs``: (case, fields array, polarity, speakers array).
    """
    both = expectations.join(outputs, "case", "left")
    has = F.coalesce(F.exists("fields", lambda f: F.contains(F.lower(f), F.lower("value"))), F.lit(False))
    bad = F.when(F.col("kind") == "forbidden", has).when(F.col("kind") == "polarity", ~F.coalesce(F.col("polarity") == F.col("value"), F.lit(False))).otherwise(~F.coalesce(F.array_contains("speakers", F.col("value")), F.lit(False)))
    return both.groupBy("case").agg(F.count_if(bad).alias("failed"))


def imported(theirs: DataFrame, ours: DataFrame) -> DataFrame:
    """id, outcome: records (id, kind, row, cell, source) of another workspace: held already, conflicting with one of ours, repeated by an earlier one of theirs, or to be imported."""
    held = ours.select(F.col("id").alias("__held")).distinct()
    cells = ours.select("kind", "row", "cell").distinct().withColumn("__taken", F.lit(True))
    first = F.row_number().over(Window.partitionBy("kind", "row", "cell", "source").orderBy("id"))
    rows = theirs.withColumn("__rn", first).join(held, F.col("id") == F.col("__held"), "left").join(cells, ["kind", "row", "cell"], "left")
    return rows.select("id", F.when(F.col("__held").isNotNull(), "held").when(F.col("__taken"), "conflict").when(F.col("__rn") > 1, "repeated").otherwise("import").alias("outcome"))


def seeded_sample(rows: DataFrame, stratum: str, key: str, n: int, seed: str) -> DataFrame:
    """``n`` rows of each stratum, chosen and shuffled by a hash of the seed and the key: the same on every run."""
    draw = F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))
    place = F.row_number().over(Window.partitionBy(stratum).orderBy(draw, key))
    return rows.withColumn("place", place).filter(F.col("place") <= n)


def designated_domains(lines: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """domain, id: the websites of listed entities (JSON lines), each domain for the first entity that has it."""
    d = lines.select("line", F.from_json("text", "id string, schema string, properties struct<website:array<string>>").alias("x"))
    sites = d.filter(F.col("x.schema").isin(*kinds)).select("line", F.col("x.id").alias("id"), F.posexplode("x.properties.website").alias("pos", "site"))
    named = sites.withColumn("domain", domain_of("site")).filter("domain <> ''")
    return named.groupBy("domain").agg(F.min_by("id", F.struct("line", "pos")).alias("id"))


def index_rows(latest: DataFrame, documents: DataFrame, preview: int = 200_000) -> DataFrame:
    """resource_id, name, status, preview of the latest document of each company; one that can't be read has blanks."""
    parsed = documents.select("content_hash", F.from_json("body", "name string, status string").alias("d"), F.substring("body", 1, preview).alias("preview"))
    return latest.join(parsed, "content_hash", "left").select("resource_id", F.coalesce("d.name", F.lit("")).alias("name"), F.coalesce("d.status", F.lit("")).alias("status"), "preview")


def address_label(*parts: Column) -> Column:
    """The parts of an address that are there, in one line."""
    return F.array_join(F.filter(F.array(*(F.trim(p) for p in parts)), lambda p: p != ""), " ")


def coverage_statement(assessed: DataFrame, texts: DataFrame) -> DataFrame:
    """doc, statement: how many of the assessed institutions a text names, so that a miss reads as a limit of coverage."""
    n = assessed.select(F.lower("name").alias("name")).distinct()
    total = n.agg(F.count(F.lit(1)).alias("total"))
    words = texts.select("doc", F.explode(F.array_distinct(F.split(F.lower("text"), r"\W+"))).alias("name"))
    hits = words.join(n, "name").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
    rows = texts.select("doc").join(hits, "doc", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("doc", F.format_string("%d of %d institutions assessed", F.coalesce("n", F.lit(0)), "total").alias("statement"))


def screen_lines(results: DataFrame, material: tuple[str, ...], findings: tuple[str, ...]) -> DataFrame:
    """company, section, predicate, blocks: the lines of a screen.

    What is unknowable is a limit, which blocks the screen if it is material;
    a fired designation is a finding; what else fired or is unknown is a fact.
    """
    fired = F.col("value").isin(S.TRUE, S.UNKNOWN)
    section = F.when(F.col("value") == S.UNKNOWABLE, "limit").when((F.col("value") == S.TRUE) & F.col("predicate").isin(*findings), "finding").when(fired, "fact")
    rows = results.withColumn("section", section).filter("section IS NOT NULL")
    return rows.select("company", "section", "predicate", ((F.col("section") == "limit") & F.col("predicate").isin(*material)).alias("blocks"))


def factsheet(subjects: DataFrame, results: DataFrame, rates: DataFrame, lead: int = 365) -> DataFrame:
    """company, as_of, section, predicate, comparator: a sheet dated ``lead`` days before each event; only what is TRUE is compared with its base rate."""
    dated = subjects.select("company", F.date_sub("event_date", lead).alias("as_of"))
    section = F.when(F.col("value") == S.TRUE, "fired").when(F.col("value") == S.FALSE, "not_fired").when(F.col("value") == S.UNKNOWN, "open").otherwise("not_evaluable")
    rows = results.join(dated, "company").join(F.broadcast(rates), "predicate", "left")  # one rate a predicate
    return rows.select("company", "as_of", section.alias("section"), "predicate", F.when(F.col("value") == S.TRUE, F.col("rate")).alias("comparator"))
