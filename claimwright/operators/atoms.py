"""The verdict on a proposed statement against the passage it was read from.

A statement is a chain of reports (who says it, outermost first) around a claim.
Each rule is a row: at which level it counts, at which step of reading it belongs,
its name, and when it holds.  A level is closed when none of its rules holds; the
statement is closed when both levels are and nothing waits for a review.  The
trace of a verdict is read off the same rows.

All rules are column expressions over one row (statement, passage); the normal
forms they share are columns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.functions.scalars import HEDGE, INDEXICAL, NEGATION, REPORTING, normal_text
from claimwright.operators.statements import LOCAL, allowed_years, context_of, id_defect, named_in, phrase_in

#: The reader's own voice: what it says was inferred, not read.
READER = "reader:inference"

# A sentence's beginning and the words that count there in capitals; frames that may turn a quote around; a plain "no".
_START = r"(?:^|[.!?:;]\s+|\()"
INDEXICAL_START = _START + r"(Currently|Now|Today|Tonight|Yesterday|Tomorrow|Recently|Lately|Nowadays|Presently|At present|These days|So far|To date|Still)\b"
HEDGE_START = _START + r"(Might|Could|Possibly|Probably|Likely|Approximately|Roughly|Reputedly|Reportedly|Apparently|Allegedly|Perhaps|Maybe)\b"
FRAME = r"\b(myth|rumou?r|false|untrue|contradict\w*|disput\w*|denie[sd]|deny|refute\w*|wrong|incorrect|unverified|could not (be )?verif\w*|otherwise|if|should|whether|is it|critics?|opponents?|claims? that|alleged\w*)\b"
PLAIN_NO = r"(?i)\bno\b(?!\.)"
# Month names by number, in the languages of the sources.
MONTHS = (
    "january januar janvier janeiro jan", "february februar février fevrier feb", "march marts märz marz mars mar", "april avril apr", "may maj mai", "june juni juin jun",
    "july juli juillet jul", "august aug août aout", "september septembre sep sept", "october oktober octobre okt oct", "november novembre nov", "december dezember décembre decembre dec dez",
)
# Relations that a claim may use, beside those of the claim model.
RELATIONS = (
    "outperforms underperforms matches has_score agrees_with disagrees_with overestimates underestimates is_inflated_by penalizes improves worsens reduces increases has_no_effect_on uses depends_on assumes produces omits "
    "decomposes_into evaluated_on evaluated_against fails_on is_sensitive_to costs causes triggers is_associated_with is_risk_factor_for is_mechanism_of is_marker_of treats defines concludes finds recommends rejects "
    "is_defined_by withholds testifies predicts constrains is_released_on has_feature"
).split()
STEPS = ("quote", "report_chain", "subject", "relation", "time", "statement", "support")
#: The steps of reasons that a claim may bring itself.
OWN_REASONS = {"subject": "subject", "relation": "relation", "time": "time", "attribution": "report_chain", "future": "time", "conditional": "statement", "ambiguous": "statement", "not_factual": "statement"}

ATOM = (
    "uid long, passage_id string, quote string, reports array<struct<id string, label string, verb string>>, subject struct<id string, label string>, predicate string, object struct<id string, label string>, value string, "
    "statement string, start string, end string, basis string, polarity string, hedge string, modality string, open_reasons array<string>"
)
PASSAGE = "passage_id string, source_id string, source_date string, text string"


def _hedged(text: Column) -> Column:
    return text.rlike(HEDGE) | text.rlike(HEDGE_START)


def _negated(text: Column) -> Column:
    return text.rlike(NEGATION) | text.rlike(PLAIN_NO)


def _global_value(ident: Column) -> Column:
    """What an identifier says by itself; null for one that means something in its source only."""
    return F.when(ident.contains(":") & ~ident.rlike(LOCAL) & ~ident.startswith("web:"), F.lower(F.regexp_replace(ident, "^[^:]*:", "")))


def _as_token(value: Column, text: Column) -> Column:
    return F.rlike(text, F.concat(F.lit(r"(?<![0-9a-z])\Q"), value, F.lit(r"\E(?![0-9a-z])")))


def month_in(date: Column, text: Column, source_date: Column) -> Column:
    """Whether a date's month (and day) is in a text: by name beside a day or the year, as a number, by its quarter, or as the source's own."""
    low, year, month, day = F.lower(text), F.substring(date, 1, 4), F.substring(date, 6, 2).cast("int"), F.substring(date, 9, 2).cast("int").cast("string")
    names = F.split(F.get(F.array(*map(F.lit, MONTHS)), month - 1), " ")
    text_has = lambda *parts: F.rlike(low, F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts)))
    quoted = lambda n: F.concat(F.lit(r"\Q"), n, F.lit(r"\E"))
    beside = lambda n: text_has(r"\b\d{1,2}\.?\s+", quoted(n), r"\b|\b", quoted(n), r"\.?\s+(\d{1,2}\b|", year, ")")
    on_day = lambda n: text_has(r"\b0?", day, r"\.?\s+", quoted(n), "|", quoted(n), r"\.?\s+0?", day, r"\b")
    named = F.exists(names, lambda n: beside(n) & (day.isNull() | on_day(n)))
    number = month.cast("string")
    counted = text_has(r"(?<!\d)0?", number, "[./-]", year, "|", year, "[./-]0?", number, r"(?!\d)|\d{1,2}[./]0?", number, "[./]")
    quarter = text_has(r"\bq", F.floor((month + 2) / 3).cast("string"), r"\s?", year, r"\b")
    own = F.coalesce(F.substring(source_date, 1, 7) == F.substring(date, 1, 7), F.lit(False))
    return own | quarter | named | F.contains(low, F.substring(date, 1, 7)) | counted


def rules(vocabulary: list[str]) -> list[tuple[str, str, str | Column, Column]]:
    """(level, step, name, condition): over the columns that ``prepared`` gives."""
    c, outer = F.col, F.get("reports", F.lit(0))
    inner = F.slice("reports", 2, F.greatest(F.size("reports") - 1, F.lit(0)))
    said = lambda what: F.exists(inner, lambda r: ~F.coalesce(r["id"] == c("source_id"), F.lit(False)) & what(r))
    by_reader = F.coalesce(outer["id"] == READER, F.lit(False))
    infers = F.exists("reports", lambda r: r["verb"] == "infers")
    represented = (F.size("reports") > 1) | (outer["verb"] != "asserts")
    around = F.concat("before", F.lit(" "), "after")
    denied = (c("polarity") == "negated") | F.exists("reports", lambda r: r["verb"] == "denies")
    estimated = F.exists("reports", lambda r: r["verb"] == "estimates")
    has_object = c("object").isNotNull()
    bare = (c("predicate").isNull()) | (~has_object & c("value").isNull())
    other = ~bare & c("predicate").startswith("other_")
    known = ~bare & ~other & c("predicate").isin(*vocabulary)
    stated, start, end = c("basis") == "stated", c("start"), c("end")
    years_in = F.size(F.array_except(F.filter(F.array(F.substring(start, 1, 4), F.substring(end, 1, 4)), lambda y: y.isNotNull()), c("years"))) == 0
    months_in = [F.when(F.length(d) > 4, month_in(d, c("text"), c("source_date"))).otherwise(F.lit(True)) for d in (start, end)]
    subject_defect, object_defect = (id_defect(c(f"{part}.id"), c("source_id"), c("normal")) for part in ("subject", "object"))
    value = _global_value(c("subject.id"))
    return [
        ("report_defect", "quote", "quote_not_in_passage", ~F.contains("normal", c("q"))),
        ("report_defect", "quote", "wrong_passage", c("passage_id") != c("read_in")),
        ("report_defect", "report_chain", "atomiser_must_infer", by_reader & (outer["verb"] != "infers")),
        ("report_defect", "report_chain", "outer_speaker_not_source", ~by_reader & ~F.coalesce(outer["id"] == c("source_id"), F.lit(False))),
        ("report_defect", "report_chain", "infers_reserved_for_atomiser", infers & ~by_reader),
        ("report_defect", "report_chain", "speaker_id_not_in_passage", said(lambda r: r["id"].isNotNull() & id_defect(r["id"], c("source_id"), c("normal")).isNotNull())),
        ("report_defect", "report_chain", "speaker_not_in_passage", said(lambda r: r["id"].isNull() & ~phrase_in(r["label"], c("normal")))),
        ("report_defect", "report_chain", "attribution_dropped", c("quote").rlike(REPORTING) & ~represented),
        ("report_open", "report_chain", "inferred", by_reader),
        ("claim_defect", "subject", F.concat(F.lit("subject_"), subject_defect), c("subject.id").isNotNull() & subject_defect.isNotNull()),
        ("claim_defect", "relation", "predicate_not_in_vocabulary", ~bare & ~other & ~known),
        ("claim_defect", "relation", F.concat(F.lit("object_"), object_defect), known & c("object.id").isNotNull() & object_defect.isNotNull()),
        ("claim_defect", "statement", "indexical_in_statement", c("said").rlike(INDEXICAL) | c("said").rlike(INDEXICAL_START)),
        ("claim_defect", "time", "asserted_time_not_source_date", (c("basis") == "asserted") & (start.isNotNull() | ~end.eqNullSafe(c("source_date")) | c("source_date").isNull())),
        ("claim_defect", "time", "stated_time_empty", stated & start.isNull() & end.isNull()),
        ("claim_defect", "time", "time_not_in_source", stated & ~years_in),
        ("claim_defect", "time", "month_not_in_source", stated & years_in & ~(months_in[0] & months_in[1])),
        ("claim_defect", "time", "time_reversed", stated & (F.left(end, F.length(start)) < F.left(start, F.length(end)))),
        ("claim_open", "subject", "subject", c("subject.id").isNull()),
        ("claim_open", "relation", "relation", bare | other | (known & has_object & c("object.id").isNull())),
        ("claim_open", "time", "time", c("basis") == "open"),
        ("claim_open", "time", "future", c("modality") == "forecast"),
        ("claim_open", "statement", "conditional", c("modality") == "conditional"),
        *(("claim_open", step, reason, F.array_contains("open_reasons", reason)) for reason, step in OWN_REASONS.items() if reason in ("attribution", "ambiguous", "not_factual")),
        *(("claim_open", step, reason, F.array_contains("open_reasons", reason)) for reason, step in OWN_REASONS.items() if reason not in ("attribution", "ambiguous", "not_factual")),
        ("review", "support", "frame_outside_quote", around.rlike(FRAME) | _negated(around) | _hedged(around) | (around.rlike(REPORTING) & ~represented)),
        ("review", "support", "subject_id_outside_quote", value.isNotNull() & ~_as_token(value, c("q"))),
        ("review", "support", "subject_outside_quote", ~named_in(c("subject.label"), c("q"))),
        ("review", "support", "object_outside_quote", has_object & ~named_in(c("object.label"), c("q"))),
        ("review", "support", "polarity_review", _negated(c("quote")) & ~denied),
        ("review", "support", "hedge_review", _hedged(c("quote")) & c("hedge").isNull() & ~_hedged(c("statement")) & ~estimated),
    ]


def prepared(atoms: DataFrame, passages: DataFrame, read_in: str = "passage_id") -> DataFrame:
    """Statements beside the passage they were read in, with the forms that rules share."""
    theirs = passages.select(F.col("passage_id").alias("read_in"), "source_id", "source_date", "text")
    own = atoms if read_in == "passage_id" else atoms.withColumnRenamed(read_in, "__read")
    rows = own.join(theirs, F.col("passage_id" if read_in == "passage_id" else "__read") == F.col("read_in"))
    rows = rows.withColumns({"normal": normal_text(F.col("text")), "q": normal_text(F.col("quote")), "years": allowed_years(F.col("text"), F.col("source_date"))})
    said = F.col("statement")
    for part in ("subject", "object"):
        label = F.col(f"{part}.label")
        said = F.when(label.isNotNull(), F.replace(said, label, F.lit(" "))).otherwise(said)
    return rows.withColumn("around", context_of(F.col("normal"), F.col("q"))).withColumns({"before": F.col("around.before"), "after": F.col("around.after"), "said": F.trim(said)})


def verdicts(atoms: DataFrame, passages: DataFrame, vocabulary: list[str] | None = None, read_in: str = "passage_id") -> DataFrame:
    """uid, report_closed, claim_closed, scope, review, defects, open, closed, closed_local, first_failure, steps.

    ``steps`` has (step, status, items) in the order of reading; ``read_in`` names the column
    with the passage that a statement was read in, where it may differ from the one it cites.
    """
    table = rules(RELATIONS if vocabulary is None else vocabulary)
    held = [F.when(F.coalesce(when, F.lit(False)), F.struct(F.lit(level).alias("level"), F.lit(step).alias("step"), (name if isinstance(name, Column) else F.lit(name)).alias("item"))) for level, step, name, when in table]
    found = prepared(atoms, passages, read_in).select("uid", "source_id", F.col("subject.id").alias("s"), F.col("object.id").alias("o"), F.array_distinct(F.filter(F.array(*held), lambda x: x.isNotNull())).alias("held"))
    of = lambda *levels: F.transform(F.filter("held", lambda h: h["level"].isin(*levels)), lambda h: h["item"])
    local = F.coalesce(F.col("s").rlike(LOCAL) | (F.col("s") == F.col("source_id")), F.lit(False)) | F.coalesce(F.col("o").rlike(LOCAL) | (F.col("o") == F.col("source_id")), F.lit(False))
    items = lambda step, kind: F.transform(F.filter("held", lambda h: (h["step"] == step) & (h["level"].endswith("_defect") if kind else ~h["level"].endswith("_defect"))), lambda h: h["item"])
    steps = F.array(*(F.struct(F.lit(s).alias("step"), F.when(F.size(items(s, True)) > 0, "defect").when(F.size(items(s, False)) > 0, "open").otherwise("ok").alias("status"), F.concat(F.array_sort(items(s, False)), items(s, True)).alias("items")) for s in STEPS))
    rows = found.withColumns({"defects": of("report_defect", "claim_defect"), "open": F.array_sort(F.array_distinct(of("report_open", "claim_open", "review"))), "review": F.array_sort(of("review")), "scope": F.when(local, "local").otherwise("global"), "steps": steps})
    rows = rows.withColumns({"report_closed": F.size(of("report_defect", "report_open")) == 0, "claim_closed": F.size(of("claim_defect", "claim_open")) == 0})
    both = F.col("report_closed") & F.col("claim_closed") & (F.size("review") == 0)
    first = F.get(F.filter("steps", lambda s: s["status"] != "ok"), F.lit(0))["step"]
    return rows.select("uid", "report_closed", "claim_closed", "scope", "review", "defects", "open", (both & ~local).alias("closed"), (both & local).alias("closed_local"), first.alias("first_failure"), "steps")
