"""Document fingerprints by winnowing (native Spark SQL only).

A text's tokens are the pieces of its words (runs of other than space and
TAB..CR): a piece ends behind each character that is not an ASCII letter other than
``a``, ``o`` and ``u`` (so behind every character of a script without spaces), at
the word's end, or after ``PIECE`` characters.  Where pieces end depends on the few characters
before, never on a text's or word's length.  Tokens are hashed; the rolling hash of every ``GRAM`` consecutive ones is their polynomial modulo
``PRIME`` (the last grams are shorter, so a text of n tokens has n grams).  Of
every ``WINDOW`` consecutive grams the least is kept, the rightmost on ties, with
its position.  Two texts that share ``GRAM + WINDOW - 1`` consecutive tokens share
a fingerprint; positions say where.

Nulls: a null text is an empty one and has an empty fingerprint.  A text with
fewer than ``WINDOW`` grams keeps its least one.  Equal texts have equal
fingerprints.  Two empty fingerprints have likeness 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.llm.common import cut, numbered_copies, row_keys

GRAM = 4
WINDOW = 4
#: Fixed values of the hash: a prime under 2^30 and a base below it.
PRIME = 1_073_741_789
BASE = 358_441_823
#: Characters of a piece at most.
PIECE = 8
_INSIDE = "[b-np-tv-zB-NP-TV-Z]"
TOKEN = rf"{_INSIDE}{{0,{PIECE - 1}}}+[^\x20\x09-\x0Db-np-tv-zB-NP-TV-Z]|{_INSIDE}{{1,{PIECE}}}+"
#: Documents in a group of neighbours.
GROUP_ROWS = 256


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds ``out`` array<long>: gram hash in the high and inverted position in the low 32 bits, by position."""
    words, grams = f"__{out}_words", f"__{out}_grams"
    names = [c for c in df.columns if c != out]
    whole = F.coalesce(F.col(text), F.lit(""))
    tokens = F.regexp_extract_all(whole, F.lit(TOKEN), F.lit(0))
    hashed = F.transform(tokens, lambda w: F.pmod(F.xxhash64(w), F.lit(PRIME)))
    df = df.select(*names, hashed.alias(words))

    def gram(h: Column, i: Column) -> Column:
        value = h
        for j in range(1, GRAM):
            value = (value * F.lit(BASE) + F.coalesce(F.get(F.col(words), i + j), F.lit(0).cast("bigint"))) % F.lit(PRIME)
        return F.shiftleft(value, 32) + (F.lit(2**32 - 1) - i)

    df = df.select(*names, F.transform(words, gram).alias(grams))
    def doubled(step: int) -> Column:
        return F.transform(grams, lambda v, i: F.least(v, F.get(F.col(grams), i + step)))

    width = 1
    while width < WINDOW:  # minima of doubled widths; null past the end is skipped by least()
        step = min(width, WINDOW - width)
        df = df.select(*names, doubled(step).alias(f"{grams}{width}"))
        df = df.select(*names, F.col(f"{grams}{width}").alias(grams))
        width += step
    full = F.slice(grams, 1, F.greatest(F.lit(1), F.size(grams) - (WINDOW - 1)))
    return df.select(*names, F.array_distinct(full).alias(out))


def hashes(fingerprint: str) -> Column:
    """The distinct gram hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftright(v, 32).cast("int")))


def rendered(fingerprint: str) -> Column:
    """``hash@position`` by position, comma-joined."""
    return F.array_join(
        F.transform(fingerprint, lambda v: F.concat(F.lower(F.hex(F.shiftright(v, 32))), F.lit("@"), (F.lit(2**32 - 1) - v.bitwiseAND(F.lit(2**32 - 1))).cast("string"))),
        ",",
    )


def likeness(a: str, b: str) -> Column:
    """Shared over all hashes of two sets."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def with_neighbours(docs: DataFrame) -> DataFrame:
    """doc_id, text (no row twice), ``__group``, ``__place`` and ``__mark``: ``GROUP_ROWS`` consecutive rows in descending order of id, and, marked, the first row of the next group.

    Only ids and hashes are ordered, by ranges; equal ids are told apart by the
    hash of the text, so a range may end between them.
    """
    keyed = docs.select("doc_id", "text", *row_keys(F.col("doc_id"), F.col("text")))
    order = [F.col("doc_id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    ranged = cut(keyed.select("doc_id", "k1", "k2").repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    parts = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # a row for each partition
    everything = Window.orderBy("part")
    before = parts.select("part", (F.sum("rows").over(everything) - F.col("rows")).alias("before"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    own = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    placed = ranged.withColumn("own", own).join(F.broadcast(before), "part").select("k1", "k2", (F.col("before") + F.col("own")).alias("place"), "all")
    at = F.col("place")
    previous = F.when(at == 0, F.col("all") - 1).otherwise(at - 1)

    def spot(place: Column, mark: int) -> Column:
        return F.struct(F.floor(place / GROUP_ROWS).cast("long").alias("__group"), F.lit(mark).alias("__mark"))

    spots = F.when(at % GROUP_ROWS == 0, F.array(spot(at, 0), spot(previous, 1))).otherwise(F.array(spot(at, 0)))
    both = keyed.join(placed, ["k1", "k2"]).select("doc_id", "text", at.alias("__place"), F.explode(spots).alias("__spot"))
    return both.select("doc_id", "text", "__place", "__spot.*")


def compare_edits(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text (last third replaced from the next document's start), and likenesses.

    The next document follows by descending id, nulls last, and the first
    follows the last; rows that repeat an id are ordered by a hash of the text,
    and of rows that repeat both all but one are followed by their own text.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    base = numbered_copies(base, ["doc_id", "text"], "__copy")
    # dealt once with the text; the window below then needs no other shuffle
    placed = with_neighbours(base.filter("__copy = 0")).repartition("__group")
    own = with_fingerprint(placed, "text", "fp").withColumn("hs", hashes("fp"))
    order = Window.partitionBy("__group").orderBy("__mark", "__place")
    followed = own.select("*", F.lead("text").over(order).alias("next_text"), F.lead("hs").over(order).alias("next_hs")).filter("__mark = 0")
    wanted = ["doc_id", "text", "fp", "hs", "next_text", "next_hs"]
    copies = with_fingerprint(base.filter("__copy > 0"), "text", "fp").withColumn("hs", hashes("fp"))
    after = followed.select(*wanted).unionByName(copies.withColumn("next_text", F.col("text")).withColumn("next_hs", F.col("hs")).select(*wanted))
    edited = after.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.expr("left(next_text, cast(floor(length(text) / 3) as int))")).alias("edited"),
        "fp",
        "hs",
        "next_hs",
    )
    both = with_fingerprint(edited, "edited", "edited_fp").withColumn("edited_hs", hashes("edited_fp"))
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        rendered("fp").alias("fingerprint"),
        rendered("edited_fp").alias("edited_fingerprint"),
        likeness("hs", "edited_hs").alias("near_edited"),
        likeness("hs", "next_hs").alias("near_next"),
    )
