"""Texts that resemble each other by longest common blocks, without meeting in all pairs.

Two texts of ``la`` and ``lb`` characters have the ratio ``2 M / (la + lb)``, M being
the characters in matching blocks, a common subsequence.  At a ratio of ``c``:

* ``M >= c (la + lb) / 2`` and ``M <= min(la, lb)``, so the shorter has at least
  ``c / (2 - c)`` of the longer's length;
* of the ``la - 1`` pairs of neighbouring characters (bigrams), a character that is
  deleted spoils two at most and one that is inserted spoils one; so they
  share at least ``(la - 1) - 2 (la - M) - (lb - M) >= (1.5 c - 1) (la + lb) - 1``.
  Where that is not above zero, in short texts, they share ``M`` single characters.

With grams in one order for all, rarest first, texts that share ``T`` of them share
one among the first ``n - T + 1`` of each (a prefix).  Only prefixes are
joined, with the length condition and what can follow the shared gram asked in
the join; what is left is verified by the ratio itself.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from claimwright.operators.pairing import similar_names


def ratio(first: Column | str, second: Column | str, cutoff: float = 0.0) -> Column:
    """Twice the characters in matching blocks over all, the blocks of ``second`` looked for in ``first``; 0 where upper bounds (by lengths, by letters whatever their order) are below ``cutoff``."""

    @F.pandas_udf(DoubleType())
    def measured(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib

        def one(x, y):
            if not x or not y:
                return 0.0
            machine = difflib.SequenceMatcher(None, x, y)
            if cutoff and (machine.real_quick_ratio() < cutoff or machine.quick_ratio() < cutoff):
                return 0.0
            return machine.ratio()

        return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=float)

    return measured(first, second)


def _short(cutoff: float) -> int:
    """Lengths together from which bigrams must be shared."""
    return math.floor(1 / (1.5 * cutoff - 1) + 1e-9) + 1


def grams(text: Column, size: int) -> Column:
    """Each gram with how often it stood before it, so that a text's are distinct."""
    n = F.length(text) - size + 1
    each = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(text, i, F.lit(size)))
    numbered = F.transform(each, lambda g, i: F.concat(g, F.lit("\x00"), F.size(F.filter(F.slice(each, 1, i), lambda x: x == g)).cast("string")))
    return F.when(n >= 1, numbered).otherwise(F.array().cast("array<string>"))


def _least_shared(length: Column, cutoff: float, kind: str) -> Column:
    """Grams that a text of this length shares with any partner, at least."""
    both = length + F.ceil(length * (cutoff / (2 - cutoff)) - 1e-9)
    if kind == "single":
        return F.ceil(both * (cutoff / 2) - 1e-9)
    return F.greatest(F.lit(1), F.ceil(F.greatest(both, F.lit(_short(cutoff))) * (1.5 * cutoff - 1) - 1 - 1e-9))


def _spread(texts: DataFrame, cutoff: float) -> DataFrame:
    """id, text, kind, n, gram: bigrams of all texts, single characters of those short enough to need them."""
    length = F.length("text")
    single = F.when(length < _short(cutoff), grams(F.col("text"), 1)).otherwise(F.array().cast("array<string>"))
    kinds = F.array(F.struct(F.lit("pair").alias("kind"), grams(F.col("text"), 2).alias("g")), F.struct(F.lit("single").alias("kind"), single.alias("g")))
    each = texts.select("id", "text", length.alias("len"), F.explode(kinds).alias("k"))
    return each.select("id", "text", "len", "k.kind", F.size("k.g").alias("n"), F.explode("k.g").alias("gram"))


def _prefixes(spread: DataFrame, often: DataFrame, cutoff: float) -> DataFrame:
    """A row for each of the first grams of a text, with all of them in order and ``rest``: how many grams it has from there on."""
    ordered = F.array_sort(F.collect_list(F.struct("df", "gram")))
    each = spread.join(often, ["kind", "gram"]).groupBy("id", "kind").agg(F.first("text").alias("text"), F.first("len").alias("len"), F.first("n").alias("n"), ordered.alias("all"))
    least = F.when(F.col("kind") == "pair", _least_shared(F.col("len"), cutoff, "pair")).otherwise(_least_shared(F.col("len"), cutoff, "single"))
    first = F.slice(F.col("all.gram"), 1, F.greatest(F.lit(0), F.col("n") - least + 1).cast("int"))
    return each.withColumn("first", first).select("id", "text", "len", "kind", "n", "first", F.posexplode("first").alias("at", "gram")).select("id", "text", "len", "kind", "first", "gram", (F.col("n") - F.col("at")).alias("rest"))


def alike(left: DataFrame, right: DataFrame, cutoff: float, where: Column | None = None) -> DataFrame:
    """(a, b, similarity) of rows (id, text) whose ratio reaches ``cutoff`` (over 2/3); ids are unique on each side.

    ``where`` may ask more of the columns that start with ``a_`` and ``b_`` beyond id and text.
    """
    if not 2 / 3 < cutoff <= 1:
        raise ValueError("the bound on shared grams needs a cutoff above 2/3")
    sides = [df.filter(F.length("text") > 0) for df in (left, right)]
    spread = [_spread(s.select("id", "text"), cutoff) for s in sides]
    often = spread[0].select("kind", "gram").union(spread[1].select("kind", "gram")).groupBy("kind", "gram").agg(F.count(F.lit(1)).alias("df"))
    x, y = (_prefixes(s, often, cutoff).select(*(F.col(c).alias(f"{p}{c}") for c in ("id", "text", "len", "rest", "first")), *(["kind", "gram"] if p == "a_" else [F.col(c).alias(f"b_{c}") for c in ("kind", "gram")])) for s, p in zip(spread, ("a_", "b_")))
    both = F.col("a_len") + F.col("b_len")
    matched = F.ceil(both * (cutoff / 2) - 1e-9)
    needed = F.when(F.col("kind") == "single", matched).otherwise(F.greatest(F.lit(1), F.ceil(both * (1.5 * cutoff - 1) - 1 - 1e-9)))
    may = (matched <= F.least("a_len", "b_len")) & (needed <= F.least("a_rest", "b_rest"))
    # which kind of gram a pair meets by depends on both lengths; it is told at the first one it shares
    kind = F.when(both < _short(cutoff), "single").otherwise("pair")
    here = (F.col("kind") == F.col("b_kind")) & (F.col("gram") == F.col("b_gram")) & (F.col("kind") == kind)
    met = x.join(y, here & may & (F.element_at(F.array_intersect("a_first", "b_first"), 1) == F.col("gram")))
    pairs = met.select("a_id", "b_id", "a_text", "b_text")
    if where is not None:
        for df, p in ((left, "a_"), (right, "b_")):
            more = [c for c in df.columns if c not in ("id", "text")]
            pairs = pairs.join(df.select(F.col("id").alias(f"{p}id"), *(F.col(c).alias(f"{p}{c}") for c in more)), f"{p}id")
        pairs = pairs.filter(where)
    scored = pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), ratio("a_text", "b_text", cutoff).alias("similarity"))
    return scored.filter(F.col("similarity") >= cutoff)


#: Known and new ids that meet in one row, of 25 characters on average at most, and new ones that are worth a task.
KNOWN_BLOCK, NEW_BLOCK, NEW_TASK = 750_000, 2_000, 50


def _nearest(known: list[str], new: list[str], cutoff: float, most: int) -> Iterator[tuple[str, str, float]]:
    """(id, near, similarity) of the ``most`` nearest at the cutoff: by falling bounds, until none left can be among them.

    Matching blocks hold no more than the letters that two texts share in any order, counted once for all known ids with
    the same letters, and no more than their longest common subsequence (or those of a text's pieces together), counted for
    the ids that the first bound leaves.  What is left is measured.
    """
    import difflib
    import heapq
    from os.path import commonprefix

    import numpy as np

    def letters(texts: list[str]) -> np.ndarray:  # of 256 kinds, so that shared ones are never too few
        return (np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) % 256).astype(np.uint8)

    lengths = np.array([len(t) for t in known], np.int64)
    flat, owner = letters(known), np.repeat(np.arange(len(known), dtype=np.int32), lengths)
    small = np.min_scalar_type(int(lengths.max(initial=0)))
    held = {k: np.bincount(owner[flat == k], minlength=len(known)).astype(small) for k in np.unique(letters(new))}
    # ids with the same letters and length have one bound: they are numbered, stand together, and one stands for all
    code, room = lengths, int(lengths.max(initial=0)) + 1
    for n in held.values():
        more = int(n.max(initial=0)) + 1
        if room * more > 1 << 62:
            code = np.unique(code, return_inverse=True)[1]
            room = len(known)
        code, room = code * more + n, room * more
    _, first, code, sizes = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
    held = {k: n[first] for k, n in held.items()}
    same = {k: int(n[0]) for k, n in held.items() if n.size and n.min() == n.max()}
    together, begins = np.argsort(code, kind="stable"), np.cumsum(sizes) - sizes
    known, lengths = [known[i] for i in together], lengths[together]
    flat, starts, head = letters(known), np.cumsum(lengths) - lengths, commonprefix(known)
    del owner, code, together

    def common(text: str, some: np.ndarray, skip: int) -> np.ndarray:
        """Length of the longest common subsequence of 64 characters at most with some of the known ids from a place on, which are gone through side by side."""
        masks = np.zeros(256, np.uint64)
        for i, k in enumerate(letters([text])):
            masks[k] |= np.uint64(1 << i)
        at, left = starts[some] + skip, lengths[some] - skip
        open_ = np.full(len(some), (1 << 64) - 1, np.uint64)
        for j in range(int(left.max())):
            letter = masks[flat[np.minimum(at + j, len(flat) - 1)]]
            met = open_ & (letter if j < left.min() else np.where(left > j, letter, np.uint64(0)))
            open_ = (open_ + met) | (open_ - met)
        return np.bitwise_count(~open_ & np.uint64((1 << len(text)) - 1)).astype(np.int64)

    steps = [*np.arange(0.95, cutoff, -0.05), cutoff]
    for text in new:
        shared, always = np.zeros(len(first), small), 0
        for k, n in zip(*np.unique(letters([text]), return_counts=True)):
            if k in same:
                always += min(same[k], int(n))
            else:
                shared += np.minimum(held[k], small.type(min(int(n), np.iinfo(small).max)))
        bound = 2.0 * (shared.astype(np.int64) + always) / (lengths[begins] + len(text))
        skip = len(commonprefix([head, text]))
        machine, best, last = difflib.SequenceMatcher(None, "", text), [], np.inf
        waiting, may = np.zeros(0, np.int64), np.zeros(0)
        for step in steps:
            kinds = np.flatnonzero((bound >= step) & (bound < last))
            n = sizes[kinds]
            fresh = np.repeat(begins[kinds] - np.cumsum(n) + n, n) + np.arange(n.sum())
            pieces = sum((common(text[i : i + 64], fresh, skip) for i in range(skip, len(text) if fresh.size else 0, 64)), np.full(len(fresh), skip))
            may = np.concatenate((may, np.minimum(np.repeat(bound[kinds], n), 2.0 * pieces / (lengths[fresh] + len(text)))))
            waiting = np.concatenate((waiting, fresh))
            now = may >= step
            for most_like, near in sorted(zip(may[now].tolist(), (known[i] for i in waiting[now])), reverse=True):
                if len(best) == most and (most_like, near) < best[0]:
                    break
                machine.set_seq1(near)
                found = (machine.ratio(), near)
                if found[0] >= cutoff:
                    (heapq.heappushpop if len(best) == most else heapq.heappush)(best, found)
            if len(best) == most and best[0][0] >= step:
                break
            waiting, may, last = waiting[~now], may[~now], step
        yield from ((text, near, similarity) for similarity, near in best)


def close_ids(new: DataFrame, known: DataFrame, cutoff: float = 0.75, most: int = 3) -> DataFrame:
    """id, near, place: known ids that a new one resembles, nearest first, ties to the later in order.

    Ids share most of their letters, so a filter by grams leaves nearly all
    pairs.  Each block of new ids meets each block of known ones; a block gives
    the nearest of its own, found by bounds, and these are ranked.
    """

    few = new.sparkSession.sparkContext.defaultParallelism

    def blocks(df: DataFrame, size: int, name: str) -> tuple[DataFrame, int]:
        ids = df.select("id").filter(F.length("id") > 0).distinct()
        rows, characters = ids.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("id")), F.lit(0))).first()
        n = max(1, math.ceil(rows / size), math.ceil(characters / (25 * size)), min(few, rows // NEW_TASK) if name == "new" else 1)
        return ids.groupBy(F.pmod(F.xxhash64("id"), F.lit(n)).alias(f"{name}_block")).agg(F.collect_list("id").alias(name)), n

    (olds, n), (news, m) = blocks(known, KNOWN_BLOCK, "known"), blocks(new, NEW_BLOCK, "new")
    met = olds.crossJoin(news).repartitionById(n * m, (F.col("known_block") * m + F.col("new_block")).cast("int")).select("known", "new")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                found = list(_nearest(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), cutoff, most))
                yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.string(), pa.float64()))], names=["id", "near", "similarity"])

    scored = met.mapInArrow(run, "id string, near string, similarity double")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.col("similarity").desc(), F.col("near").desc()))
    return scored.withColumn("place", place).filter(F.col("place") <= most).select("id", "near", "place")


@F.pandas_udf(StringType())
def plain_name(labels: pd.Series) -> pd.Series:
    """Decomposed, what is not ASCII left out, case folded, runs of letters and digits joined by one space."""
    import re
    import unicodedata

    return labels.map(lambda x: " ".join(re.findall(r"[a-z0-9]+", unicodedata.normalize("NFKD", x or "").encode("ascii", "ignore").decode().casefold())))


def name_candidates(entities: DataFrame, cutoff: float = 0.8, most: int | None = 40) -> DataFrame:
    """a, b, similarity: entities of different sources whose names look alike, the most similar first.

    ``entities`` (entity, label, source, linked): ``linked`` is what an entity is
    known as already; a null source or one and the same ``linked`` makes no pair.  Names look alike at
    the ratio, or where one's words hold all of the other's.  Ties by a and b, a before b.  ``most`` null: all.
    """
    named = entities.filter(F.col("source").isNotNull()).select(F.col("entity").alias("id"), plain_name("label").alias("text"), "source", "linked").filter("text <> ''")
    apart = (F.col("a_id") < F.col("b_id")) & (F.col("a_source") != F.col("b_source")) & (F.col("a_linked") != F.col("b_linked"))
    close = alike(named, named, cutoff, apart)
    words = named.select(F.col("id").alias("entity"), "source", F.array_distinct(F.split("text", " ")).alias("tokens"))
    held = similar_names(words)
    for side in "ab":
        held = held.join(named.select(F.col("id").alias(side), F.col("text").alias(f"{side}_text"), F.col("linked").alias(f"{side}_linked")), side)
    held = held.filter("a_linked <> b_linked").select("a", "b", ratio("a_text", "b_text").alias("similarity")).join(close.select("a", "b"), ["a", "b"], "left_anti")
    both = close.unionByName(held).withColumn("similarity", F.round("similarity", 2))
    ordered = both.orderBy(F.col("similarity").desc(), "a", "b")
    return ordered if most is None else ordered.limit(most)
