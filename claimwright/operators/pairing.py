"""Joins of what is declared with what is registered, and of names and identifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.operators.graph import connected
from claimwright.operators.temporal import in_force


def paired(declared: DataFrame, registered: DataFrame, on: str) -> DataFrame:
    """claim, status, declared, counterparts, staleness_days for each declared claim.

    ``declared`` (claim, subject, predicate, value) meets the registered values
    of its subject and predicate in force on the day; without any it is
    ``unregistered``, else it corroborates or contradicts them.
    """
    live = registered.filter(in_force(on)).select("subject", "predicate", F.col("value").alias("r_value"))
    changed = registered.groupBy("subject", "predicate").agg(F.max("valid_from").alias("changed"))
    rows = declared.join(live, ["subject", "predicate"], "left").join(changed, ["subject", "predicate"], "left")
    out = rows.groupBy("claim", "subject", "predicate", "value").agg(F.array_sort(F.collect_set("r_value")).alias("counterparts"), F.max("changed").alias("changed"))
    status = F.when(F.size("counterparts") == 0, "unregistered").when(F.array_contains("counterparts", F.col("value")), "corroborated").otherwise("contradicted")
    return out.select("claim", status.alias("status"), F.col("value").alias("declared"), F.array_join("counterparts", "|").alias("counterparts"), F.datediff(F.lit(on).cast("date"), "changed").alias("staleness_days"))


def headcount_agrees(declared: Column, registered: Column) -> Column:
    """Within a factor of two."""
    return (declared * 2 >= registered) & (declared <= registered * 2)


def by_identifier(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(id, target): equal normalised identifiers; digits alone must agree on the country too.

    ``rows`` (id, identifier, country), ``targets`` (target, identifier, countries array).
    """
    both = rows.join(targets.withColumnRenamed("identifier", "__i"), F.col("identifier") == F.col("__i"))
    digits = F.col("identifier").rlike("^[0-9]+$") & F.col("country").isNotNull()
    return both.filter(~digits | F.array_contains("countries", F.lower("country"))).select("id", "target").distinct()


#: Entities of one source and one set of tokens that meet others in one row.
CHUNK = 1_000


def _held(sets: DataFrame) -> DataFrame:
    """(a, b): sets of tokens of which b holds all of a and more.

    They share the smaller one's rarest token, so only the lists of rare tokens are joined.
    """
    spread = sets.select("t", F.explode("t").alias("tok"))
    df = spread.groupBy("tok").agg(F.count(F.lit(1)).alias("df"))
    rarest = spread.join(df, "tok").groupBy("t").agg(F.min(F.struct("df", "tok")).alias("r")).select(F.col("t").alias("a"), F.col("r.tok").alias("tok"))
    both = rarest.join(spread.withColumnRenamed("t", "b"), "tok")
    return both.filter((F.size("a") < F.size("b")) & (F.size(F.array_except("a", "b")) == 0)).select("a", "b")


def similar_names(entities: DataFrame, tokens: str = "tokens") -> DataFrame:
    """(a, b): entities of different sources of which one's distinctive tokens hold all of the other's.

    Only sets of tokens are compared.  The entities of a source with one set meet those of others in
    chunks, so pairs are told where two chunks meet and are not shuffled, but for those of an entity in several rows.
    """
    each = entities.select("entity", "source", F.array_sort(F.array_distinct(tokens)).alias("t")).filter((F.size("t") > 0) & F.col("entity").isNotNull() & F.col("source").isNotNull()).distinct()
    sets = each.select("t").distinct()
    links = _held(sets).withColumn("own", F.lit(False)).union(sets.select("t", "t", F.lit(True)))
    salt = F.pmod(F.xxhash64("entity"), F.lit(1 + entities.count() // (1_000 * CHUNK)))
    repeats = each.groupBy("entity").agg((F.count(F.lit(1)) > 1).alias("twice"))
    groups = each.join(repeats, "entity").groupBy("t", "source", "twice", salt).agg(F.collect_list("entity").alias("all"))
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("all") - 1) / CHUNK).cast("int")), lambda i: F.slice("all", i * CHUNK + 1, F.lit(CHUNK)))
    chunks = groups.select("t", "source", "twice", F.explode(cut).alias("e"))
    x, y = (chunks.select(F.col("t").alias(k), *(F.col(c).alias(f"{c}_{k}") for c in ("source", "twice", "e"))) for k in "ab")
    apart = F.when(F.col("own"), F.col("source_a") < F.col("source_b")).otherwise(F.col("source_a") != F.col("source_b"))
    met = links.join(x, "a").join(y, "b").filter(apart).select("e_a", "e_b", (F.col("twice_a") | F.col("twice_b")).alias("twice"))

    def pairs(rows: DataFrame) -> DataFrame:
        each = rows.select("e_b", F.explode("e_a").alias("x")).select("x", F.explode("e_b").alias("y"))
        return each.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))

    # meetings are few and their pairs many: as many partitions as keep all cores at work to the end, not as few as their bytes need
    n = 8 * entities.sparkSession.sparkContext.defaultParallelism
    once = met.filter(~F.col("twice")).repartition(n, F.element_at("e_a", 1), F.element_at("e_b", 1))
    return pairs(once).unionByName(pairs(met.filter("twice")).distinct())


def name_links(entities: DataFrame, tokens: str = "tokens") -> DataFrame:
    """entity, class_id, n_links: entities with the same tokens are one class, told by its least; ``n_links`` counts the pairs of ``similar_names`` that an entity is in.

    Only classes meet, by their rarest token; how many entities a source has in a class gives the number of links.
    """
    each = entities.select("entity", "source", F.coalesce(F.array_sort(F.array_distinct(tokens)), F.array().cast("array<string>")).alias("t"))
    classes = each.groupBy("t").agg(F.min("entity").alias("class_id"))
    pairs = similar_names(classes.select(F.col("class_id").alias("entity"), F.col("class_id").alias("source"), "t"), "t")
    own = classes.filter(F.size("t") > 0).select(F.col("class_id").alias("a"), F.col("class_id").alias("b"))
    links = pairs.union(pairs.select("b", "a")).union(own)
    member = each.join(classes, "t").select("entity", "source", "class_id")
    counts = member.filter(F.col("source").isNotNull()).groupBy(F.col("class_id").alias("b"), "source").agg(F.count(F.lit(1)).alias("n"))
    reach = links.join(counts, "b").groupBy(F.col("a").alias("class_id"), "source").agg(F.sum("n").alias("same"))
    every = reach.groupBy("class_id").agg(F.sum("same").alias("every"))
    rows = member.join(every, "class_id", "left").join(reach, ["class_id", "source"], "left")
    n = F.when(F.col("source").isNotNull(), F.col("every") - F.coalesce("same", F.lit(0)))
    return rows.select("entity", "class_id", F.coalesce(n, F.lit(0)).cast("long").alias("n_links"))


def disagreements(rows: DataFrame, most: int = 6) -> DataFrame:
    """topic, a, b, place: the first pairs of a topic whose sources differ and whose values or polarities do.

    How many later rows disagree with a row follows from counts of later rows
    by source, by value and by both, so only the rows that the first ``most``
    pairs begin with, at most ``most`` of a topic, meet the rows after them.
    """
    def later(*same: str) -> Column:
        return F.count(F.lit(1)).over(Window.partitionBy("topic", *same).orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, -1))

    value = ("value", "negated")
    partners = later() - later("source") - later(*value) + later("source", *value)
    counted = rows.withColumn("__n", partners)
    earlier = F.coalesce(F.sum("__n").over(Window.partitionBy("topic").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    a = counted.withColumn("__before", earlier).filter((F.col("__n") > 0) & (F.col("__before") < most)).select("topic", F.col("pos").alias("a"), F.col("source").alias("s_a"), F.col("value").alias("v_a"), F.col("negated").alias("n_a"))
    b = rows.select(F.col("topic").alias("t2"), F.col("pos").alias("b"), F.col("source").alias("s_b"), F.col("value").alias("v_b"), F.col("negated").alias("n_b"))
    differ = (F.col("s_a") != F.col("s_b")) & ((F.col("v_a") != F.col("v_b")) | (F.col("n_a") != F.col("n_b")))
    pairs = a.join(b, (F.col("topic") == F.col("t2")) & (F.col("a") < F.col("b")) & differ)
    place = F.row_number().over(Window.partitionBy("topic").orderBy("a", "b"))
    return pairs.withColumn("place", place).filter(F.col("place") <= most).select("topic", "a", "b", "place")


def context_window(text: Column, start: Column, end: Column, margin: int = 600, most: int = 6000) -> Column:
    """A passage with up to ``margin`` characters on each side, at most ``most`` in all."""
    left = F.greatest(F.lit(0), start - margin)
    right = F.least(F.length(text), end + margin)
    return F.substr(text, left + 1, F.least(F.lit(most), right - left))


def canonical_ids(aliases: DataFrame) -> DataFrame:
    """alias, canonical: ids that accepted aliases link, through any number of them, and the least of each group."""
    accepted = aliases.filter("accepted").select(F.col("alias").alias("a"), F.col("canonical").alias("b")).filter("a <> b")
    return connected(accepted).select(F.col("node").alias("alias"), F.col("component").alias("canonical"))


def resolved(keys: DataFrame, aliases: DataFrame, key: str = "key") -> DataFrame:
    """Keys with the canonical id of all that accepted aliases link them with; their own where nothing does."""
    known = canonical_ids(aliases).select(F.col("alias").alias(key), "canonical")
    return keys.join(known, key, "left").withColumn("canonical", F.coalesce("canonical", F.col(key)))


def flag_in_force(observations: DataFrame, current: DataFrame) -> DataFrame:
    """subject, state: of the last human observation; stale once a pinned document is no longer current."""
    last = observations.groupBy("subject").agg(F.max_by(F.struct("kind", "pinned"), "seq").alias("x")).select("subject", "x.kind", "x.pinned")
    now = current.groupBy(F.col("subject").alias("__s")).agg(F.collect_set("content_hash").alias("now"))
    both = last.join(now, F.col("subject") == F.col("__s"), "left")
    gone = F.size(F.array_except("pinned", F.coalesce("now", F.array().cast("array<string>")))) > 0
    return both.select("subject", F.when(F.col("kind") == "withdraw", "withdrawn").when(gone, "stale").otherwise("active").alias("state"))


def majority_changes(owns: DataFrame) -> DataFrame:
    """company, changed_on, earlier, later: the last two days on which majority holdings began, if their holders differ."""
    days = owns.filter(F.col("share") > 0.5).groupBy("company", "valid_from").agg(F.array_join(F.array_sort(F.collect_set(F.col("holder").cast("string"))), "|").alias("holders"))
    order = Window.partitionBy("company").orderBy(F.col("valid_from").desc())
    last = days.withColumn("rn", F.row_number().over(order)).withColumn("earlier", F.lead("holders").over(order)).filter("rn = 1")
    return last.filter("earlier IS NOT NULL AND earlier <> holders").select("company", F.col("valid_from").alias("changed_on"), "earlier", F.col("holders").alias("later"))
