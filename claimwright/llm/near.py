"""Near-duplicate documents by b-bit MinHash.

A document's set holds the hashes of its distinct 5-word shingles (words are
runs of other than space and TAB..CR, A-Z lower-cased; with fewer words, the
whole sequence).  Documents with equal sets form a class, and all that follows
works on classes.

* Signature: the least value of the set under each of ``BANDS * ROWS``
  multiplicative permutations.  The low ``BITS`` bits of the minima are packed;
  similarity is estimated from the count of equal places, corrected for the
  chance collisions that b bits give.
* Candidates: classes that share a band of ``ROWS`` minima share a bucket.  At
  similarity 0.85 a pair shares none with probability 2e-8.
* A bucket is never expanded into its pairs.  Each member meets the bucket's
  first document.  Estimates that lie more than six standard deviations under
  the threshold drop out, the rest is confirmed on full sets, and the links
  give components.
* What a first document can't tell are links between members of different
  components.  They are found by a prefix filter over all bucket members: with
  shingles ordered by frequency, two sets that link share a shingle among the
  first ``n - ceil(threshold * n) + 1`` of each.  Members meet at such a shingle
  only if they are in different components, and if sizes, the shingles that no
  other member has, the places of the shared one and the estimate allow a link;
  all of that is asked within the join, so that hardly a pair leaves it that is
  not then confirmed.  No pair is dropped otherwise.

Nulls: a document without words (or null) has an empty set and no links.  Rows
with a null id link like others; a component's id is its least non-null one.
Rows that repeat an id belong together only if their sets link.  An empty table
gives an empty result.  Extra columns take no part.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.llm.common import WORD_BREAK, WordHashes, cut, cut_counted, mix64, row_keys, ship, slices, windows_hash
from claimwright.llm.graph import components

SHINGLE = 5
ROWS = 4
BANDS = 24
BITS = 2
PLACES = ROWS * BANDS
#: Text whose shingles a worker holds at once.
CHUNK_BYTES = 1 << 20
NO_ID = 2**63 - 1

_A = mix64(np.arange(1, PLACES + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    n = min(SHINGLE, len(words))
    with np.errstate(over="ignore"):
        return np.unique(windows_hash(hashes.of(words), n) + np.uint64(SHINGLE - n))


def set_key(shingles: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh3_128_digest(shingles.tobytes())


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), PLACES) least values under the permutations; sets are not empty."""
    starts = np.cumsum([0, *map(len, sets[:-1])])
    flat = np.concatenate(sets)
    out = np.empty((len(sets), PLACES), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(PLACES):
            out[:, k] = np.minimum.reduceat(flat * _A[k], starts)
    return out


def signed(docs: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text) -> doc_id, k1, k2, c (class), n, sig array<long>, bands array<long>."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            for rows in slices(batch, 3, CHUNK_BYTES):
                sets = [shingle_set(t, hashes) for t in rows.column(3).to_pylist()]
                some = [i for i, s in enumerate(sets) if len(s)]
                sigs: list = [None] * len(sets)
                bands: list = [None] * len(sets)
                if some:
                    least = minima([sets[i] for i in some])
                    # of a product the high bits are the mixed ones: minima are mixed before bits are kept
                    low = mix64(least) & np.uint64((1 << BITS) - 1)
                    words = low.reshape(len(some), PLACES // 32, 32) << (np.arange(32, dtype=np.uint64) * np.uint64(BITS))
                    packed = np.bitwise_or.reduce(words, axis=2).astype(np.int64)
                    banded = least.reshape(len(some), BANDS, ROWS)
                    with np.errstate(over="ignore"):
                        bh = np.arange(1, BANDS + 1, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
                        for r in range(ROWS):
                            bh = mix64(bh ^ banded[:, :, r]) + np.uint64(r)
                    bh = bh.astype(np.int64)
                    for j, i in enumerate(some):
                        sigs[i], bands[i] = packed[j], bh[j]
                yield pa.RecordBatch.from_arrays(
                    [
                        *rows.columns[:3],
                        pa.array([set_key(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(sigs, pa.list_(pa.int64())),
                        pa.array(bands, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "k1", "k2", "c", "n", "sig", "bands"],
                )

    return docs.select("doc_id", "k1", "k2", "text").mapInArrow(run, "doc_id long, k1 long, k2 long, c binary, n long, sig array<long>, bands array<long>")


def estimate(a: str, b: str) -> Column:
    """Similarity from the bit count of differing places, corrected for chance collisions."""
    low = F.lit(0x5555555555555555)
    differ = F.zip_with(a, b, lambda x, y: F.bit_count((x.bitwiseXOR(y).bitwiseOR(F.shiftrightunsigned(x.bitwiseXOR(y), 1))).bitwiseAND(low)))
    same = 1.0 - F.aggregate(differ, F.lit(0), lambda acc, x: acc + x) / F.lit(PLACES)
    chance = 1.0 / (1 << BITS)
    return (same - chance) / (1.0 - chance)


def least_estimate(threshold: float) -> float:
    """Six standard deviations of the estimate under the threshold."""
    chance = 1.0 / (1 << BITS)
    p = chance + (1 - chance) * threshold
    return threshold - 6 * (p * (1 - p) / PLACES) ** 0.5 / (1 - chance)


def _sizes_allow(n: str, m: str, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def likely(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The (a, b) whose sizes and estimate allow the threshold."""
    for side in "ab":
        pairs = pairs.join(members.select(F.col("i").alias(side), F.col("n").alias(f"n_{side}"), F.col("sig").alias(f"sig_{side}")), side)
    return pairs.filter(_sizes_allow("n_a", "n_b", percent)).filter(estimate("sig_a", "sig_b") >= least_estimate(percent / 100)).select("a", "b")


def confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The (a, b) that reach the threshold on full sets."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        last: tuple[int, np.ndarray] | None = None
        for batch in batches:
            for some in slices(batch, 3, CHUNK_BYTES):
                a, ta, tb = (some.column(i).to_pylist() for i in (0, 2, 3))
                keep = []
                for i in range(len(a)):
                    if last is None or last[0] != a[i]:
                        last = (a[i], shingle_set(ta[i], hashes))
                    x, y = last[1], shingle_set(tb[i], hashes)
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        keep.append(i)
                yield pa.RecordBatch.from_arrays([some.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    left = texts.select(F.col("i").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("i").alias("b"), F.col("text").alias("text_b"))
    # the side with many pairs a text comes last, so that its text is held once
    return pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _shingles(texts: DataFrame) -> DataFrame:
    """(i, n, s): the shingles of every member."""

    def run(batches):
        import pyarrow as pa

        hashes = WordHashes()
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                s = shingle_set(t, hashes)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), i, np.int64)), pa.array(np.full(len(s), len(s), np.int64)), pa.array(s.astype(np.int64))], names=["i", "n", "s"])

    return texts.select("i", "text").mapInArrow(run, "i long, n long, s long")


def _prefixes(texts: DataFrame, percent: int) -> DataFrame:
    """(s, i, n, r, place): shared shingles in the prefix of members that can link to anyone.

    ``r`` counts a member's shingles that another member has, ``place`` is the
    shingle's in the order by frequency, where unshared ones come first.
    """
    each = _shingles(texts)
    often = each.groupBy("s").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")
    own = Window.partitionBy("i")
    shared = each.join(often, "s").select("s", "i", "n", F.count(F.lit(1)).over(own).alias("r"), F.row_number().over(own.orderBy("df", "s")).alias("rn"))
    placed = shared.select("s", "i", "n", "r", (F.col("n") - F.col("r") + F.col("rn")).alias("place"))
    longest = F.col("n") - F.ceil(percent * F.col("n") / 100.0) + 1
    # the least partner has percent of the size
    return placed.filter((F.col("place") <= longest) & (100 * F.col("r") >= percent * F.col("n"))).select("s", "i", "n", "r", "place")


def _apart(known: DataFrame) -> DataFrame:
    """``known`` for the pairs of different labels that share a shingle: with ``bit``, ``up`` and ``side``.

    Shingles of one label drop out.  Of others the labels are numbered; two
    numbers differ first at one bit, above which they are equal, and meet there on
    different sides.  So rows of one label, however many, never meet.
    """
    each = Window.partitionBy("s")
    labels = known.select("s", "label").distinct().select("s", "label", (F.row_number().over(each.orderBy("label")) - 1).alias("number"), F.count(F.lit(1)).over(each).alias("labels"))
    many = known.join(labels.filter("labels > 1"), ["s", "label"])
    bits = F.length(F.bin(F.col("labels") - 1))
    dealt = many.withColumn("bit", F.explode(F.sequence(F.lit(0), bits - 1)))
    return dealt.select(*known.columns, "bit", F.expr("shiftright(number, bit + 1)").alias("up"), F.expr("shiftright(number, bit) & 1").alias("side"))


def _across(prefixes: DataFrame, members: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct (a, b) of different components that may link."""
    known = prefixes.join(members.select("i", "sig"), "i").join(labels.withColumnRenamed("node", "i"), "i", "left").withColumn("label", F.coalesce("label", "i"))
    apart = _apart(known)
    one = apart.filter("side = 0")
    twin = apart.filter("side = 1").select(*(F.col(c).alias(f"t_{c}") for c in apart.columns))
    total = percent * (F.col("n") + F.col("t_n"))
    bound = F.least(F.col("r"), F.col("t_r"), F.col("n") - F.col("place") + 1, F.col("t_n") - F.col("t_place") + 1)
    may = _sizes_allow("n", "t_n", percent) & ((100 + percent) * bound >= total)
    here = (F.col("s") == F.col("t_s")) & (F.col("bit") == F.col("t_bit")) & (F.col("up") == F.col("t_up"))
    met = one.join(twin, here & may & (estimate("sig", "t_sig") >= least_estimate(percent / 100)))
    return met.select(F.least("i", "t_i").alias("a"), F.greatest("i", "t_i").alias("b")).distinct()


def grouped(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, k1, k2 (the row's key), n (set size), label (of its component, null without words), component (least non-null id)."""
    ship(docs.sparkSession)
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    rows = docs.select(ident.alias("doc_id"), *row_keys(ident, text), text.alias("text"))
    done = cut(signed(rows))
    # one class for each distinct set, told by its first document
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "k1", "k2", "n", "sig", "bands"))
    classes = done.filter("c IS NOT NULL").groupBy("c").agg(first.alias("x")).select("c", "x.*")
    # numbers are short; they stay, as they are written
    classes = cut(classes.withColumn("i", F.monotonically_increasing_id()))
    banded = classes.select("i", "doc_id", F.explode("bands").alias("bucket"))
    least = F.min(F.struct("doc_id", "i")).alias("least")
    buckets = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), least).filter("size > 1").select("bucket", F.col("least.i").alias("leader"))
    met = banded.join(buckets, "bucket").filter("leader <> i")
    # the leader, which has many pairs, is always a
    star = cut(met.select(F.col("leader").alias("a"), F.col("i").alias("b")).distinct())
    ends = star.select(F.col("a").alias("i")).union(star.select("b")).distinct()
    members = cut(classes.select("i", "k1", "k2", "n", "sig").join(ends, "i", "left_semi"))
    # the texts of bucket members, once: what follows shuffles these only
    texts = cut(rows.select("k1", "k2", "text").join(members.select("i", "k1", "k2"), ["k1", "k2"]).select("i", "text").dropDuplicates(["i"]))
    links = cut(confirmed(likely(star, members, percent), texts, percent))
    labels = components(links)
    more, found = cut_counted(confirmed(_across(_prefixes(texts, percent), members, labels, percent), texts, percent))
    if found:
        labels = components(links.union(more), labels)
    # classes without a link are their own component
    named = classes.select("c", "i", "doc_id").join(labels.withColumnRenamed("node", "i"), "i", "left").withColumn("label", F.coalesce("label", "i"))
    ids = named.groupBy("label").agg(F.min("doc_id").alias("component"))
    of_class = named.join(ids, "label").select("c", "label", F.when(F.col("component") != NO_ID, F.col("component")).alias("component"))
    out = done.select("doc_id", "k1", "k2", "c", "n").join(of_class, "c", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "k1", "k2", "n", "label", component.alias("component"))


def near_duplicates(docs: DataFrame, *, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row for every row of ``docs``.

    Links join sets with ``100 * intersection >= percent * union``.
    """
    out = grouped(docs, percent=percent, id_col=id_col, text_col=text_col)
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def keep_first(docs: DataFrame, percent: int = 85, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, that of the least id (nulls last); columns unchanged.

    Rows that repeat an id and a text are one document, of which one row stays.
    Documents without words link with nothing and all stay.
    """
    names = docs.columns
    ident, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "k1", "k2")).alias("x")
    best = grouped(docs, percent=percent, id_col=id_col, text_col=text_col).filter("label IS NOT NULL").groupBy("label").agg(first)
    best = best.select(F.col("x.k1").alias("__b1"), F.col("x.k2").alias("__b2"))
    wordless = F.regexp_replace(F.coalesce(text, F.lit("")), WORD_BREAK, "") == ""
    k1, k2 = row_keys(ident, text)
    keyed = docs.filter(~wordless).select("*", k1.alias("__k1"), k2.alias("__k2"))
    # repeated rows shrink where they are read, before the shuffle that the join then uses too
    once = keyed.dropDuplicates(["__k1", "__k2"])
    kept = once.join(best, (F.col("__k1") == F.col("__b1")) & (F.col("__k2") == F.col("__b2")), "left_semi")
    return kept.select(*names).unionByName(docs.filter(wordless).select(*names))
