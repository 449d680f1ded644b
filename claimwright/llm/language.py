"""Language identification by Bayesian fusion of evidence.

For each document the log posterior of a language is the sum of

* the text's log likelihood under hashed byte-trigram models, tempered to at
  most ``TEXT_TRIGRAMS`` trigrams' worth, since trigrams overlap;
* the log probability of the declared markup language given the language;
* the log probability of the address suffix given the language;
* the log prior of the language at the host, smoothed hierarchically: the
  host's counts over its parent's, the parent's over the corpus's.

The tables of the last three come from grouped aggregation over all documents
of what the text alone says.  The trigram models are fitted on a bounded
sample of declared documents (``SAMPLE_ROWS``), whole texts.

A document is rejected if its text has no trigram of letters, or if no
language reaches the posterior ``min_posterior``.

Nulls: a null text has no trigrams and is rejected; a null declaration, suffix
or host is a value of its own, and an empty declaration is a null one.  Ties go to the language first in code-point
order.  Repeated rows get equal results.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import cut, ship, slices, small_or_shuffled

#: The sample that trigram models are fitted on holds about this many rows at most.
SAMPLE_ROWS = 12_000
BUCKETS = 1 << 15
TEXT_TRIGRAMS = 60
#: Evidence tables up to this many keys are broadcast, larger ones shuffled.
BROADCAST_KEYS = 50_000
SMOOTH = 4.0
#: Text that a worker scores or counts at once; arrays hold some 60 bytes for each of its bytes with four languages.
CHUNK_BYTES = 1 << 18


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each trigram of letters (other runs shrink to one space), and each text's first position (one more at the end)."""
    import re

    gap = re.compile(rb"[\x00-\x40\x5b-\x60\x7b-\x7f]+")
    cleaned = [b" " + gap.sub(b" ", (t or "").lower().encode()) + b" " for t in texts]
    ends = np.cumsum([0, *map(len, cleaned)])
    data = np.frombuffer(b"".join(cleaned) + b"  ", np.uint8).astype(np.int32)
    keys = (data[:-2] * 961 + data[1:-1] * 31 + data[2:]) & (BUCKETS - 1)
    keys[data[1:-1] == 32] = BUCKETS  # centred on a gap: no evidence
    keys[np.maximum(ends[1:] - 1, 0)] = BUCKETS  # these reach into the next text
    return keys, ends


@dataclass
class TextModel:
    languages: list[str]
    table: np.ndarray  # (BUCKETS + 1, languages) log probabilities; the last row is zero

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean log likelihood of each text in each language, and its number of trigrams."""
        sums, counts, at = [], [], 0
        while at < len(texts):
            stop, held = at, 0
            while stop < len(texts) and (stop == at or held < CHUNK_BYTES):
                held += len(texts[stop] or "")
                stop += 1
            keys, ends = trigrams(texts[at:stop])
            sums.append(np.add.reduceat(self.table[keys], ends[:-1], axis=0))
            counts.append(np.add.reduceat((keys < BUCKETS).astype(np.int64), ends[:-1]))
            at = stop
        n = np.concatenate(counts) if counts else np.empty(0, np.int64)
        s = np.concatenate(sums) if sums else np.empty((0, len(self.languages)))
        return s / np.maximum(n, 1)[:, None], n


def fit_text_model(docs: DataFrame, text: str, declared: str, key: str) -> TextModel:
    """Trigram counts of a hash-chosen sample of declared rows, for every label in it."""
    known = docs.filter(F.col(declared).isNotNull() & F.col(text).isNotNull())
    one_in = max(1, math.ceil(docs.count() / SAMPLE_ROWS))
    sample = known.filter(F.pmod(F.xxhash64(F.col(key), F.col(text).cast("string"), F.lit("language")), F.lit(one_in)) == 0).select(F.col(declared).cast("string"), F.col(text).cast("string"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch, 1, CHUNK_BYTES):
                by_label: dict[str, list[str]] = {}
                for label, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    by_label.setdefault(label, []).append(t)
                for label, some in by_label.items():
                    keys, _ = trigrams(some)
                    found, n = np.unique(keys[keys < BUCKETS], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.string()), pa.array(found.astype(np.int32)), pa.array(n.astype(np.int64))], names=["label", "bucket", "n"])

    # the sample bounds the rows, so the (label, trigram) counts are bounded too, however many labels there are
    counted = sample.mapInArrow(run, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    names = counted.column("label").to_pylist()
    languages = sorted(set(names))
    if not languages:
        return TextModel(["und"], np.zeros((BUCKETS + 1, 1)))
    place = {x: i for i, x in enumerate(languages)}
    counts = np.zeros((BUCKETS, len(languages)))
    counts[counted.column("bucket").to_numpy(), [place[x] for x in names]] = counted.column("n").to_numpy()
    seen = counts.sum(axis=1) > 0
    logs = np.log((counts + 0.5) / (counts + 0.5).sum(axis=0))
    logs[~seen] = logs.min()  # a trigram of no language speaks for none
    return TextModel(languages, np.vstack([logs, np.zeros(len(languages))]))


def text_evidence(docs: DataFrame, model: TextModel, text: str) -> DataFrame:
    """All columns of ``docs`` but ``text``, plus ``ll`` (mean log likelihoods) and ``n_trigrams``."""
    rest = [c for c in docs.columns if c != text]
    rows = docs.select(*rest, F.col(text).cast("string").alias("__text"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = batch.num_columns - 1
            mean, n = map(np.concatenate, zip(model.score([]), *(model.score(some.column(at).to_pylist()) for some in slices(batch, at, CHUNK_BYTES))))
            ends = np.arange(0, mean.size + 1, mean.shape[1], dtype=np.int32)
            ll = pa.ListArray.from_arrays(ends, pa.array(mean.ravel().astype(np.float64)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ll, pa.array(n)], names=[*rest, "ll", "n_trigrams"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "__text")
    return rows.mapInArrow(run, f"{kinds}, ll array<double>, n_trigrams long")


def _counts(rows: DataFrame, key: str, n: int) -> DataFrame:
    """Rows by what their text alone says, for each key: an array of n counts."""
    sums = [F.sum(F.when(F.col("first") == i, 1.0).otherwise(0.0)) for i in range(n)]
    return rows.groupBy(F.col(key).alias(f"__{key}")).agg(F.array(*sums).alias(f"{key}_n"))


def _plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def identify(docs: DataFrame, *, text: str = "text", declared: str = "declared", suffix: str = "suffix", host: str = "host", parent: str = "parent", key: str = "doc_id", min_posterior: float = 0.5) -> DataFrame:
    """``key``, row_hash (of the text), language, posterior, n_trigrams, kept: one row for every row of ``docs``."""
    ship(docs.sparkSession)
    base = docs.select(
        F.col(key),
        F.xxhash64(F.col(text)).alias("row_hash"),
        F.col(text).alias("text"),
        F.when(F.trim(F.col(declared).cast("string")) != "", F.col(declared).cast("string")).alias("declared"),
        *(F.col(c).cast("string").alias(a) for c, a in ((suffix, "suffix"), (host, "host"), (parent, "parent"))),
    )
    model = fit_text_model(base, "text", "declared", key)
    n = len(model.languages)
    alone = text_evidence(base, model, "text").withColumn("first", F.when(F.col("n_trigrams") > 0, (F.array_position("ll", F.array_max("ll")) - 1).cast("int")))
    rows = cut(alone)
    counted = rows.filter(F.col("first").isNotNull())
    overall = counted.agg(*(F.coalesce(F.sum(F.when(F.col("first") == i, 1.0).otherwise(0.0)), F.lit(0.0)) for i in range(n))).first()
    prior = np.array(overall, float) + 0.5
    whole = F.array(*(F.lit(float(p)) for p in prior / prior.sum()))
    per_language = F.array(*(F.lit(float(p)) for p in prior))

    def smoothed(counts: Column, over: Column) -> Column:
        total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, over, lambda c, p: (c + SMOOTH * p) / (total + SMOOTH))

    none = F.array_repeat(F.lit(0.0), n)
    scored = rows
    for name in ("declared", "suffix", "host", "parent"):
        table = cut(_counts(counted, name, n))
        keys = table.count()
        scored = scored.join(small_or_shuffled(table, keys, BROADCAST_KEYS), F.col(name).eqNullSafe(F.col(f"__{name}")), "left").drop(f"__{name}")
        scored = scored.withColumn(f"{name}_n", F.coalesce(f"{name}_n", none))
    # P(value | language) for the declaration and the suffix, with the value's corpus share as its base
    def given_language(counts: Column) -> Column:
        share = (F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + 0.5) / F.lit(float(prior.sum()) + 1.0)
        return F.zip_with(counts, per_language, lambda c, total: F.log((c + SMOOTH * share) / (total + SMOOTH)))

    at_host = smoothed(F.col("host_n"), smoothed(F.col("parent_n"), whole))
    weight = F.least(F.col("n_trigrams"), F.lit(TEXT_TRIGRAMS)).cast("double")
    logs = F.transform("ll", lambda x: x * weight)
    for part in (given_language(F.col("declared_n")), given_language(F.col("suffix_n")), F.transform(at_host, lambda x: F.log(x))):
        logs = _plus(logs, part)
    scored = scored.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    names = F.array(*(F.lit(x) for x in model.languages))
    best = F.element_at(names, F.array_position("logs", F.col("top")).cast("int"))
    posterior = 1.0 / F.aggregate("logs", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    has_text = F.col("n_trigrams") > 0
    return scored.select(
        key,
        "row_hash",
        F.when(has_text, best).alias("language"),
        F.when(has_text, posterior).otherwise(0.0).alias("posterior"),
        "n_trigrams",
        (has_text & (posterior >= min_posterior)).alias("kept"),
    )


def document_view(docs: DataFrame) -> DataFrame:
    """The columns ``identify`` asks for, from ``documents``: the source is the host and its name without digits the parent."""
    return docs.select("doc_id", "text", F.col("lang").alias("declared"), F.lit(None).cast("string").alias("suffix"), F.col("source").alias("host"), F.regexp_replace("source", "[0-9]+$", "").alias("parent"))


def page_view(pages: DataFrame) -> DataFrame:
    """The same from ``pages``: markup language, address suffix, host and its registered domain."""
    host = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)", 1))
    labels = F.split(host, r"\.")
    visible = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>", " "), r"(?s)<[^>]*>|&[a-z#0-9]+;", " ")
    return pages.select(
        "page_id",
        visible.alias("text"),
        F.lower(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([A-Za-z]+)", 1)).alias("declared"),
        F.element_at(labels, -1).alias("suffix"),
        host.alias("host"),
        F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), ".").alias("parent"),
    )


def keep_identified(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """``docs`` without the rows that ``judged`` rejects; columns unchanged."""
    names = docs.columns
    rejected = cut(judged.filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("row_hash").alias("__hash")).distinct())
    marked = docs.withColumn("__row", F.xxhash64("text"))
    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    return marked.join(small_or_shuffled(rejected, rejected.count(), 1_000_000), on, "left_anti").select(*names)
