"""Spelling variants by letter-parity masks.

A word's mask has a bit for each letter, set where the letter occurs an odd
number of times.  One inserted, deleted or replaced letter flips at most two
bits, so of a mask's three ``BANDS`` at least one stays as it was.  Words
meet where a band is equal and their lengths differ by one at most; the edit also
touches only one stretch of a few letters, so the key they meet under holds
the rest of the word as well (without it, a band of a few frequent letters would
be shared by a share of all words, and pairs would grow with the square of the
vocabulary).  What meets is verified: masks within two bits, then the edit
distance.

Texts are read once and counted in the task before anything is shuffled; the
rest works on the vocabulary.

Nulls: a null text has no words, a null id counts as an empty one.  Repeated rows
count again.  Ties for a form go to the first word in code-point order.  Texts
and words of any length are read whole.  An empty table gives no rows; columns
beside id and text are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import cut, ship

#: Letters of words: A to Z in both cases, and U+00C0 to U+00FF.
RUN = "[A-Za-zÀ-ÿ]"
#: A letter's bit: 26 for a to z, the others share what is left of 63.
BITS, BANDS = 63, 3
#: Letters of a stretch, and how many stretches a word has at least and at most (those of very long words are longer).
STRETCH, FEWEST, MOST = 3, 3, 64
#: Distinct words that a task counts before it sends their counts on.
HELD = 200_000
#: One run in so many loses a letter, by its hash.
NOISE = 31


def noisy(run: str, start: int) -> str:
    """The run, without one letter where its hash says so; ``start`` is the hash of what stands before it."""
    h = zlib.crc32(run.encode(), start)
    if h % NOISE:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7) -> DataFrame:
    """word, n: the words of at least ``least`` letters of all texts."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("string"), F.col(text_col).cast("string")).filter(F.col(text_col).isNotNull())
    # a shorter run gives no such word, with a letter less or not
    runs = re.compile(RUN + "{" + str(least) + ",}")

    def run(batches):
        import pyarrow as pa

        def sent(held):
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])

        held: Counter[str] = Counter()
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1), strict=True):
                start = zlib.crc32(f"{ident.as_py() or ''}:".encode())
                # bytes are lower-cased from A to Z only
                for word, n in Counter(runs.findall(text.as_py().encode().lower().decode())).items():
                    word = noisy(word, start)
                    if len(word) >= least:
                        held[word] += n
                if len(held) >= HELD:
                    yield sent(held)
                    held.clear()
        yield sent(held)

    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def mask(word: Column) -> Column:
    """Parities of a word's letters."""

    def bit(letter: Column) -> Column:
        code = F.ascii(letter)
        at = F.when(code < 192, code - 97).otherwise(26 + (code - 192) % (BITS - 26))
        return F.call_function("shiftleft", F.lit(1).cast("long"), at)

    return F.aggregate(F.transform(F.split(word, ""), bit), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))


def band(of: Column, k: int) -> Column:
    """The bits of one band; neighbours in the alphabet are in different bands."""
    return of.bitwiseAND(F.lit(sum(1 << i for i in range(k, BITS, BANDS))))


def _stretches(shorter: Column) -> Column:
    return F.greatest(F.lit(FEWEST), F.least(F.lit(MOST), F.floor(shorter / STRETCH))).cast("int")


def _rest(word: Column, shorter: Column, k: Column) -> Column:
    """What stands before and behind stretch ``k`` of words whose shorter one has this length."""
    parts = _stretches(shorter)
    before = F.floor(shorter * k / parts).cast("int")
    behind = shorter - F.floor(shorter * (k + 1) / parts).cast("int")
    return F.concat(F.left(word, before), F.right(word, behind))


def near_pairs(words: DataFrame) -> DataFrame:
    """Pairs of words (a, a_n, b, b_n), each once, that differ by one letter inserted, deleted or replaced."""
    masked = words.select("word", "n", F.length("word").alias("len"), mask(F.col("word")).alias("mask"))
    # as one of two words of its own length or the shorter one, and as the longer one
    sides = masked.select("*", F.explode(F.array(F.lit(False), F.lit(True))).alias("longer")).withColumn("short", F.col("len") - F.col("longer").cast("int"))
    at = sides.withColumn("stretch", F.explode(F.sequence(F.lit(0), _stretches(F.col("short")) - 1)))
    rest = at.withColumn("rest", F.xxhash64("short", "stretch", _rest(F.col("word"), F.col("short"), F.col("stretch"))))
    banded = rest.select("*", F.explode(F.array(*(F.struct(F.lit(k).alias("band"), F.xxhash64("rest", F.lit(k), band(F.col("mask"), k)).alias("key")) for k in range(BANDS)))).alias("__key"))
    keyed = banded.select("word", "n", "mask", "longer", "short", "stretch", "__key.band", "__key.key")
    a, b = keyed.filter("not longer").alias("a"), keyed.alias("b")
    x, y = F.col("a.mask"), F.col("b.mask")
    first = F.lit(BANDS - 1)
    for k in reversed(range(BANDS - 1)):
        first = F.when(band(x, k) == band(y, k), F.lit(k)).otherwise(first)
    # an edit between two stretches, or in a run of one letter, is seen in both; it is told in the first

    def meets(k: Column) -> Column:
        return _rest(F.col("a.word"), F.col("a.short"), k) == _rest(F.col("b.word"), F.col("a.short"), k)

    before = F.filter(F.sequence(F.lit(0), F.col("a.stretch")), lambda k: (k < F.col("a.stretch")) & meets(k))
    # one expression, so that what is cheap is asked first
    no = F.lit(False)
    holds = F.when(~F.col("b.longer") & (F.col("a.word") >= F.col("b.word")), no).when(F.bit_count(x.bitwiseXOR(y)) > 2, no).when(F.col("a.band") != first, no)
    holds = holds.when(F.levenshtein("a.word", "b.word", 1) != 1, no).otherwise(F.size(before) == 0)
    met = a.join(b, (F.col("a.key") == F.col("b.key")) & holds)
    return met.select(F.col("a.word").alias("a"), F.col("a.n").alias("a_n"), F.col("b.word").alias("b"), F.col("b.n").alias("b_n"))


def forms(words: DataFrame, times: int = 10) -> DataFrame:
    """word, n, n_near, form, form_n: the most frequent near word, where it occurs at least ``times`` as often."""
    sides = F.array(*(F.struct(F.col(x).alias("word"), F.col(y).alias("near"), F.col(f"{y}_n").alias("near_n")) for x, y in ("ab", "ba")))
    both = near_pairs(words).select(F.explode(sides).alias("side")).select("side.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    told = words.join(best, "word", "left")
    enough = -F.col("best.less") >= F.lit(times) * F.col("n")
    return told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n"))


def rooted(formed: DataFrame, times: int = 10) -> DataFrame:
    """``formed`` with ``root``: the last word that forms lead to.

    Each form is ``times`` as frequent as its word, which bounds the steps;
    every round doubles how many of them a word has taken.
    """
    formed = cut(formed)
    top = formed.agg(F.max("n")).first()[0] or 1
    steps, reach = 0, top
    while reach >= times:
        steps, reach = steps + 1, reach // times
    at = formed.select("word", F.coalesce("form", "word").alias("root"))
    done = 1
    while done < steps:
        on = at.filter("word <> root").select(F.col("word").alias("root"), F.col("root").alias("__on"))
        at = cut(at.join(on, "root", "left").select("word", F.coalesce("__on", "root").alias("root")))
        done *= 2
    return formed.join(at, "word")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = 7, least_n: int = 2, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word that occurs at least ``least_n`` times."""
    words = cut(word_counts(docs, id_col=id_col, text_col=text_col, least=least).filter(F.col("n") >= least_n))
    return rooted(forms(words, times), times).select("word", "form", "root", "n", "n_near", "form_n")
