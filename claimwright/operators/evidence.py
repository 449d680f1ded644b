"""Quotes, claim groups, track records and matrices of explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.scalars import employee_counts, founded_years, normal_text
from claimwright.operators.temporal import known_by


def quoted_in(quotes: DataFrame, texts: DataFrame, *, words: int = 5, text_key: str = "doc_id", quote_key: str = "item_id") -> DataFrame:
    """(quote_key, text_key) where the normalised quote occurs in the normalised text, word borders or not.

    A quote's first and last word may be parts of words, those between are whole
    ones, so texts that hold the first ``words`` of these are compared with the
    whole quote.  Quotes too short for that meet texts by their first four
    characters, or by their first one.  Only keys and hashes are exploded and
    joined; texts are joined to the distinct pairs that are left.
    """
    q = quotes.select(quote_key, normal_text(F.col("text")).alias("__quote")).filter("__quote <> ''")
    t = texts.select(text_key, normal_text(F.col("text")).alias("__text")).filter("__text <> ''")
    inner = F.split("__quote", " ")
    kind = F.when(F.size(inner) >= words + 2, "words").when(F.length("__quote") >= 4, "four").otherwise("one")
    q = q.withColumn("__kind", kind)
    starts = {"words": F.xxhash64(F.array_join(F.slice(inner, 2, words), " ")), "four": F.xxhash64(F.substring("__quote", 1, 4)), "one": F.xxhash64(F.substring("__quote", 1, 1))}

    def grams(k: str) -> DataFrame:
        if k == "words":
            # the words are a column of their own: a lambda would split the text again for each place
            split = t.select(text_key, F.split("__text", " ").alias("__w")).filter(F.size("__w") >= words)
            each = F.transform(F.sequence(F.lit(1), F.size("__w") - words + 1), lambda i: F.xxhash64(F.array_join(F.slice("__w", i, words), " ")))
            return split.select(text_key, F.explode(F.array_distinct(each)).alias("__gram"))
        size = 4 if k == "four" else 1
        long = t.filter(F.length("__text") >= size)
        each = F.transform(F.sequence(F.lit(1), F.length("__text") - size + 1), lambda i: F.xxhash64(F.substr("__text", i, F.lit(size))))
        return long.select(text_key, F.explode(F.array_distinct(each)).alias("__gram"))

    # three kinds at most: texts are gone through only for those that occur
    kinds = sorted(r["__kind"] for r in q.select("__kind").distinct().collect())
    met = None
    for k in kinds:
        asked = q.filter(F.col("__kind") == k).select(quote_key, starts[k].alias("__gram"))
        pairs = grams(k).join(asked, "__gram").select(quote_key, text_key)
        met = pairs if met is None else met.unionByName(pairs)
    if met is None:
        return q.select(quote_key).join(t.select(text_key), F.lit(False))
    both = met.distinct().join(q.select(quote_key, "__quote"), quote_key).join(t, text_key)
    return both.filter(F.contains("__text", F.col("__quote"))).select(quote_key, text_key)


def same_text(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """text_sha, n, first: normalised texts that several pages share."""
    sha = F.sha2(normal_text(F.col(text)).cast("binary"), 256)
    return pages.groupBy(sha.alias("text_sha")).agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("first")).filter("n > 1")


def website_facts(pages: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, founded, employees: a row for each statement of a page, with one of the two; a page without any has one row of nulls."""
    none = F.lit(None).cast("int")
    founded = F.transform(founded_years(F.col(text)), lambda y: F.struct(y.alias("founded"), none.alias("employees")))
    employees = F.transform(employee_counts(F.col(text)), lambda n: F.struct(none.alias("founded"), n.alias("employees")))
    return pages.select(key, F.explode_outer(F.concat(founded, employees)).alias("x")).select(key, "x.founded", "x.employees")


def claim_groups(claims: DataFrame, parts: list[str]) -> DataFrame:
    """group_id, n_claims, n_sources, n_polarities of claims that say the same."""
    key = F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(p).cast("string"), F.lit("\x1e")) for p in parts)), 256)
    return claims.groupBy(key.alias("group_id")).agg(F.count(F.lit(1)).alias("n_claims"), F.count_distinct("source").alias("n_sources"), F.count_distinct("negated").alias("n_polarities"))


def track_record(entries: DataFrame) -> DataFrame:
    """source, confirmed, refuted, unresolved over the first closed report of each (source, claim).

    ``by_groups`` are the origin groups that a resolution rests on; only groups
    other than the source's own count.
    """
    first = entries.filter("closed").groupBy("source", "claim").agg(F.min_by(F.struct("origin", "verb", "value", "by_groups"), "seq").alias("x")).select("source", "x.*")
    independent = F.size(F.array_except("by_groups", F.array("origin"))) > 0
    settled = F.col("value").isin("TRUE", "FALSE") & independent
    right = (F.col("value") == "TRUE") != (F.col("verb") == "denies")
    outcome = F.when(~F.coalesce(settled, F.lit(False)), "unresolved").when(right, "confirmed").otherwise("refuted")
    return first.withColumn("o", outcome).groupBy("source").agg(*(F.count_if(F.col("o") == k).alias(k) for k in ("confirmed", "refuted", "unresolved")))


def weigh(cells: DataFrame) -> DataFrame:
    """explanation, inconsistent, disputed, confirmed, accommodated and place of competing explanations.

    ``cells`` (question, row, explanation, reading, disputed, tested): a row
    confirms the one explanation it is consistent with after a test, if no rival
    is consistent with it too.
    """
    consistent = F.col("reading") == "consistent"
    rivals = cells.filter(consistent).groupBy("question", "row").agg(F.count(F.lit(1)).alias("fits"))
    rows = cells.join(rivals, ["question", "row"], "left")
    alone = consistent & (F.col("fits") == 1)
    out = rows.groupBy("question", "explanation").agg(
        F.count_if((F.col("reading") == "inconsistent") & ~F.col("disputed")).alias("inconsistent"),
        F.count_if((F.col("reading") == "inconsistent") & F.col("disputed")).alias("disputed"),
        F.count_if(alone & F.col("tested")).alias("confirmed"),
        F.count_if(consistent & ~F.col("tested")).alias("accommodated"),
    )
    from pyspark.sql import Window

    order = Window.partitionBy("question").orderBy("inconsistent", "disputed", F.col("confirmed").desc(), "explanation")
    return out.withColumn("place", F.row_number().over(order))


def discriminating(cells: DataFrame) -> DataFrame:
    """question, row of rows that are inconsistent for some explanations and not for others."""
    bad = F.col("reading") == "inconsistent"
    return cells.groupBy("question", "row").agg(F.bool_or(bad).alias("some"), F.bool_and(bad).alias("all")).filter("some AND NOT all").select("question", "row")


def position(evidence: DataFrame, rows: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """What stood at a day: evidence whose source was known by then, and rows that rest on it."""
    known = evidence.filter(known_by("source_date", by))
    return known, rows.join(known.select("evidence"), "evidence", "left_semi")


def missing_references(rows: DataFrame, column: str, targets: DataFrame, target: str) -> DataFrame:
    """Rows whose reference has no target."""
    return rows.join(targets.select(F.col(target).alias("__t")), F.col(column) == F.col("__t"), "left_anti")


def report_chain(turns: DataFrame, conv: str, turn: str, speaker: str) -> DataFrame:
    """Each statement with all the speakers before it, outermost first.

    The chains of one conversation grow with the square of its turns, as each holds the whole of it.
    """
    from pyspark.sql import Window

    before = Window.partitionBy(conv).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return turns.withColumn("chain", F.array_join(F.collect_list(speaker).over(before), ">"))


def report_ranks(turns: DataFrame, conv: str, turn: str, speaker: str) -> DataFrame:
    """conv, turn, speaker, rank (from 1, outermost first): chains as rows, for conversations of any length.

    The chain of a statement is what its conversation has at smaller ranks.
    """
    from claimwright.operators.stats import ranked

    return ranked(turns.select(conv, turn, speaker), [conv], turn, speaker)


def severity(status: Column) -> Column:
    return F.when(status == "defect", 2).when(status == "open", 1).otherwise(0)


def first_failure(items: DataFrame, key: str = "atom") -> DataFrame:
    """atom, worst, first_step: the worst status of a trace and the first step that is not ok."""
    bad = F.col("status") != "ok"
    return items.groupBy(key).agg(F.max(severity(F.col("status"))).alias("worst"), F.min(F.when(bad, F.col("step"))).alias("first_step"))
