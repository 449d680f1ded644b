"""Personal data: patterns, and information-theoretic sanitisation of what gives them away (native Spark SQL only).

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers,
leftmost and non-overlapping per kind; matches that fail their check are
dropped without retrying.

The method adds spans for runs of mixed letters and digits that hold at least
``SECRET_BITS`` bits (keys and access tokens), and for terms that reveal a
protected entity (the value of a base span or of such a run).  A context is the
up to ``CONTEXT_WORDS`` words of letters on each side of a span, however far
they lie, but not beyond the third next span.  Over all distinct texts, ``n_e``
counts the distinct contexts of entity e, ``n_te`` those that hold term t,
``n_t`` the texts with t and ``N`` all texts; copies of a text or a context
count once.  The term discloses the share ``PMI(t; e) / IC(e)`` of what there
is to know about e, with ``IC = ln(N / n_e)`` and ``PMI = ln(p N / n_t)``, where
``p = (n_te + PRIOR n_t / N) / (n_e + PRIOR)`` is the term's share of the
contexts, drawn towards its share of the texts: terms of an entity with one or
two contexts are told apart by how rare they are.  In the contexts of e, terms
at or above ``REMOVE`` are removed, those at or above ``GENERALISE`` generalised.

The patterns are written so that no text makes them backtrack at length: a
match begins where its first run of characters begins, or right after the
previous match (``\\G``), and what need not be given back is possessive.

Nulls: a null text is an empty one and has no spans.  Rows are told apart by
(doc_id, hash of the text), so repeated rows get equal spans.  Offsets count
code points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import cut, small_or_shuffled

CONTEXT_WORDS = 5
#: Gaps between spans that a context reaches over.
CONTEXT_GAPS = 3
#: Where this many characters hold enough words, only they are searched.
NEAR_CHARS = 200
#: Weight, in contexts, of a term's share of the texts.
PRIOR = 1.0
#: A run of letters and digits without a break that holds so much, at 4 bits a character, is protected too.
SECRET_BITS = 96
GENERALISE = 0.5
REMOVE = 0.8
#: Tables of terms, one short row each, are broadcast up to this many rows; others are joined by shuffle.
BROADCAST_ROWS = 200_000
#: Added spans are broadcast up to this many bytes, at ``SPAN_BYTES`` each.
BROADCAST_BYTES, SPAN_BYTES = 16 << 20, 128

#: kind -> pattern and the quick test that a text may hold one.
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
KINDS = list(PATTERNS)
TERM = r"\p{L}{3,}+"
SPAN = "struct<kind:string,start:int,end:int,value:string>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, add, few: bool = False) -> Column:
    """array<int>: what ``add`` makes of 0 and all items before each one.

    Blocks of about the square root of the number of items are summed first and
    then gone through, so that no long array is copied for each item; not so
    where items are known to be ``few``.
    """

    def gone_through(part: Column, start: Column, step) -> Column:
        first = F.struct(start.alias("at"), F.expr("cast(array() as array<int>)").alias("out"))
        return F.aggregate(part, first, lambda acc, x: F.struct(step(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    def in_blocks(all_items: Column) -> Column:
        step = F.greatest(F.lit(1), F.ceil(F.sqrt(F.size(all_items))).cast("int"))
        last = F.floor((F.size(all_items) - 1) / step).cast("int")
        parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), last)), lambda k: F.slice(all_items, k * step + 1, step))
        return _let(parts, lambda bs: _let(gone_through(bs, F.lit(0), lambda at, part: F.aggregate(part, at, add)), lambda starts: F.flatten(F.transform(bs, lambda part, k: gone_through(part, F.get(starts, k), add)))))

    return gone_through(items, F.lit(0), add) if few else _let(items, in_blocks)


def located(text: Column, pattern: str, kind: str, few: bool = False) -> Column:
    """array<SPAN> of a pattern's matches; offsets from the lengths of matches and of what lies between."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = _let(found, lambda f: F.zip_with(F.slice(F.split(text, pattern, -1), 1, F.size(f)), f, lambda g, m: F.struct(F.length(g).alias("gap"), m.alias("m"))))

    def spans(both: Column) -> Column:
        before = running(both, lambda at, x: at + x["gap"] + F.length(x["m"]), few)

        def span(x: Column, at: Column) -> Column:
            start = at + x["gap"]
            return F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + F.length(x["m"])).alias("end"), x["m"].alias("value"))

        return F.zip_with(both, before, span)

    return _let(pairs, spans)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "phone":
        return (n >= 9) & (n <= 15)
    return F.when((n >= 13) & (n <= 19), _luhn(_digits(m))).otherwise(False)


def base_spans(text: Column) -> Column:
    """array<SPAN> by kind and start."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    has_digit = text.rlike("[0-9]")
    parts = []
    for kind, (pattern, sign) in PATTERNS.items():
        may = F.lit(True) if kind == "email" else has_digit
        if sign:
            may = F.contains(text, F.lit(sign)) & may
        parts.append(F.when(may, F.filter(located(text, pattern, kind), _checked(kind))).otherwise(none))
    return F.concat(*parts)


def _checked(kind: str):
    return lambda s: _valid(kind, s["value"])


def secrets(text: Column) -> Column:
    """array<SPAN> of runs that hold at least ``SECRET_BITS`` bits by their length and alphabet: keys and access tokens."""
    letters = lambda v: F.length(F.regexp_replace(v, "[^A-Za-z]", ""))
    digits = lambda v: F.length(_digits(v))
    # of n characters, half of them digits, half letters, each is one of 16 at least
    dense = lambda s: (4 * F.length(s["value"]) >= SECRET_BITS) & (F.least(letters(s["value"]), digits(s["value"])) * 8 >= F.length(s["value"]))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return F.when(text.rlike(f"(?<![A-Za-z0-9])[A-Za-z0-9]{{{SECRET_BITS // 4}}}"), F.filter(located(text, r"(?:\G|(?<![A-Za-z0-9]))[A-Za-z0-9]++", "secret"), dense)).otherwise(none)


def _value(kind: Column, value: Column) -> Column:
    return F.when(kind.isin("card", "phone"), _digits(value)).otherwise(F.lower(value))


def _nearest(side: Column) -> Column:
    """The beginning of a text up to the end of its word ``CONTEXT_WORDS + 1``, or all of its words."""
    words = lambda n: rf"\A(?:(?s:.*?){TERM}){{{n}}}"
    near = F.substr(side, F.lit(1), F.lit(NEAR_CHARS))
    # the last of these words may be cut, those before it are whole
    enough = near.rlike(words(CONTEXT_WORDS + 2))
    return F.regexp_extract(F.when(enough, near).otherwise(side), words(f"0,{CONTEXT_WORDS + 1}"), 0)


def _contexts(text: Column, entities: Column) -> Column:
    """array<struct<entity, terms array<SPAN>>>: the terms on both sides of every span, offsets within the text.

    Each gap between spans is searched once, from both ends.
    """

    def moved(terms: Column, by: Column) -> Column:
        return F.transform(terms, lambda t: F.struct(t["kind"].alias("kind"), (t["start"] + by).alias("start"), (t["end"] + by).alias("end"), F.lower(t["value"]).alias("value")))

    # a term touching the span is not a word of it
    def tail(gap: Column, end: Column) -> Column:
        part = F.reverse(_nearest(F.reverse(gap)))
        return _let(part, lambda p: moved(F.filter(located(p, TERM, "term", few=True), lambda t: t["end"] < F.length(p)), end - F.length(p)))

    def head(gap: Column, start: Column) -> Column:
        return moved(F.filter(located(_nearest(gap), TERM, "term", few=True), lambda t: t["start"] > 0), start)

    def of_gap(g: Column) -> Column:
        return _let(F.substr(text, g["start"] + 1, g["end"] - g["start"]), lambda gap: F.struct(head(gap, g["start"]).alias("head"), tail(gap, g["end"]).alias("tail")))

    def around(spans: Column) -> Column:
        before = F.zip_with(spans, running(spans, lambda at, s: F.greatest(at, s["end"])), lambda s, at: F.struct(at.alias("start"), F.greatest(s["start"], at).alias("end")))
        gaps = F.concat(before, F.array(F.struct(F.array_max(F.transform(spans, lambda s: s["end"])).alias("start"), F.length(text).alias("end"))))

        def of_span(s: Column, i: Column, near: Column) -> Column:
            first = F.greatest(F.lit(1), i + 2 - CONTEXT_GAPS)
            left = F.flatten(F.transform(F.slice(near, first, i + 2 - first), lambda g: g["tail"]))
            right = F.flatten(F.transform(F.slice(near, i + 2, F.lit(CONTEXT_GAPS)), lambda g: g["head"]))
            last = _let(left, lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - CONTEXT_WORDS + 1), F.lit(CONTEXT_WORDS)))
            return F.struct(_value(s["kind"], s["value"]).alias("entity"), F.concat(last, F.slice(right, 1, CONTEXT_WORDS)).alias("terms"))

        return _let(F.transform(gaps, of_gap), lambda near: F.transform(spans, lambda s, i: of_span(s, i, near)))

    return _let(F.array_sort(F.transform(entities, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), s["value"].alias("value")))), around)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Base spans of every row, and the added spans of the rows that have any.

    (doc_id, row_hash, base array<SPAN>) and (doc_id, row_hash, added
    array<SPAN>), the latter once for each (doc_id, row_hash).
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row_hash"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    spans = rows.withColumn("base", base_spans(F.col("text")))
    spans = spans.withColumn("secret", secrets(F.col("text")))
    entities = F.concat("base", "secret")
    contexts = _contexts(F.col("text"), entities)
    # one scan of the texts; what is kept of it is the spans and their contexts
    found = cut(spans.select("doc_id", "row_hash", "base", "secret", F.when(F.size(entities) > 0, contexts).alias("contexts")))
    kept_secrets = found.filter(F.size("secret") > 0).select("doc_id", "row_hash", F.explode("secret").alias("s")).select("doc_id", "row_hash", "s.start", "s.end", "s.kind", F.col("s.value").alias("term"))
    n_docs = max(1, found.select("row_hash").distinct().count())
    seen = found.select("doc_id", "row_hash", F.explode("contexts").alias("c")).select("doc_id", "row_hash", "c.entity", "c.terms")
    words = F.transform("terms", lambda t: t["value"])
    distinct = seen.select("entity", F.xxhash64(words).alias("context"), F.array_distinct(words).alias("words")).dropDuplicates(["entity", "context"])
    n_e = distinct.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"))
    pairs = distinct.select("entity", F.explode("words").alias("term")).groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_te"))
    pairs = cut(pairs.join(n_e, "entity"))
    terms = cut(pairs.select("term").distinct())
    n_terms = terms.count()
    if n_terms == 0:
        return found.select("doc_id", "row_hash", "base"), _gathered(kept_secrets)
    # distinct texts with each such term, over whole texts of all documents
    own = rows.select("row_hash", "text").dropDuplicates(["row_hash"])
    each = own.select(F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(TERM), F.lit(0)), F.lower))).alias("term"))
    # counted before the join (an inner one: a semi join would be pushed below the count), so that it makes a row a term
    n_t = each.groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(small_or_shuffled(terms, n_terms, BROADCAST_ROWS), "term")
    n = F.lit(float(n_docs))
    pmi = F.log((F.col("n_te") * n / F.col("n_t") + PRIOR) / (F.col("n_e") + PRIOR))
    told = pairs.join(n_t, "term").withColumn("share", pmi / F.greatest(F.log(n / F.col("n_e")), F.lit(1e-9)))
    telling = cut(told.filter((F.col("share") >= GENERALISE) & (F.col("n_e") < n)).select("entity", "term", F.when(F.col("share") >= REMOVE, "remove").otherwise("generalise").alias("kind")))
    n_telling = telling.count()
    places = seen.select("doc_id", "row_hash", "entity", F.explode("terms").alias("t")).select("doc_id", "row_hash", "entity", F.col("t.value").alias("term"), F.col("t.start").alias("start"), F.col("t.end").alias("end"))
    hits = places.join(small_or_shuffled(telling, n_telling, BROADCAST_ROWS), ["entity", "term"]).select("doc_id", "row_hash", "start", "end", "kind", "term")
    return found.select("doc_id", "row_hash", "base"), _gathered(hits.unionByName(kept_secrets))


def _gathered(hits: DataFrame) -> DataFrame:
    """The spans of each row, in order; a place that two entities tell differently about is removed."""
    by_kind = hits.groupBy("doc_id", "row_hash", "start", "end").agg(F.max("kind").alias("kind"), F.first("term").alias("term"))
    span = F.struct("kind", "start", "end", F.col("term").alias("value"))
    return by_kind.groupBy("doc_id", "row_hash").agg(F.array_sort(F.collect_list(span)).alias("added"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def with_added(base: DataFrame, added: DataFrame) -> DataFrame:
    few = added.withColumnsRenamed({"doc_id": "__id", "row_hash": "__hash"})
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("row_hash") == F.col("__hash"))
    return base.join(few, on, "left").drop("__id", "__hash").withColumn("added", F.coalesce("added", F.expr(f"cast(array() as array<{SPAN}>)")))


def digests(docs: DataFrame) -> DataFrame:
    """Counts, hash of the base spans and all spans of every row, from the operator's own output."""
    both = with_added(*find(docs))
    counts = [F.size(F.filter("base", _kind_is(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    more = [F.size("added").cast("long").alias("n_added"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")]
    return both.select("doc_id", *counts, F.sha2(_joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"), *more)


def _kind_is(kind: str):
    return lambda s: s["kind"] == kind


def sanitised(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of ``text_col`` replaced by its tag; other columns, and rows without spans, unchanged."""
    names = docs.columns
    _, added = find(docs, text_col=text_col)
    added = cut(added.withColumnsRenamed({"doc_id": "__id", "row_hash": "__hash", "added": "__added"}))
    held = added.agg(F.sum(F.size("__added") * SPAN_BYTES + SPAN_BYTES)).first()[0] or 0
    marked = docs.withColumn("__row", F.xxhash64(text_col))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    joined = marked.join(small_or_shuffled(added, held, BROADCAST_BYTES), on, "left")
    text = F.col(text_col).cast("string")
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    joined = joined.withColumn("__spans", F.when(text.isNull(), none).otherwise(F.concat(base_spans(text), F.coalesce("__added", none))))
    by_start = F.array_sort(F.transform("__spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))

    def pieces(spans: Column) -> Column:
        def piece(s: Column, at: Column) -> Column:
            wide = F.when(F.substr(text, s["start"] + 1, F.lit(1)).rlike(r"\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))
            tag = F.when(s["kind"] == "remove", F.lit("")).when(s["kind"] == "generalise", wide).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            # overlapping: one tag covers both
            return F.when(s["start"] >= at, F.concat(F.substr(text, at + 1, s["start"] - at), tag)).otherwise("")

        over = running(spans, lambda at, s: F.greatest(at, -s["back"]))
        end = F.array_max(F.transform(spans, lambda s: -s["back"]))
        return F.concat(F.array_join(F.zip_with(spans, over, piece), ""), F.substr(text, end + 1, F.length(text)))

    return joined.withColumn("__new", F.when(F.size("__spans") > 0, _let(by_start, pieces)).otherwise(text)).select(*(F.col("__new").alias(c) if c == text_col else F.col(c) for c in names))
