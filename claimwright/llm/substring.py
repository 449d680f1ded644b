"""Exact removal of repeated word windows by super-k-mer partitioning.

A window is ``width`` consecutive words of one document (words are runs of
other than space and TAB..CR).  The minimiser of a window is its leftmost
``MER``-word sequence of least hash; consecutive windows with the minimiser at
the same place make a super-k-mer, which travels as one string of its words to
the bucket of its minimiser.  There all windows are sorted and equal
neighbours, compared word by word, are repeats.

* Equal windows have equal minimisers, so a minimiser that occurs once holds no
  repeat: only hashes travel to find that out, and such super-k-mers stay home.
* Equal strings are counted by their hashes (160 bits with the minimiser's), and
  of each just one row sends the words, so a passage travels once, however many
  copies it has.
* A minimiser with many distinct strings (some hundreds: enough to set all bits
  of a 64-bit sketch of them), as in a line that many documents share, is split:
  its windows are counted one by one, by 128-bit hashes, with partial sums where
  they are made, so no bucket holds them all.  Before that the words that some
  neighbouring windows have in common are counted in the same way; where those
  occur once, their windows stay home.
* A bucket's strings are streamed in order of the bucket; only one stretch of
  whole buckets is held at a time.  What comes back of a string is one bit for
  each of its windows.

Nulls: a null text has no words, ``kept_sha256`` is then that of ``''``.  Ids
may be null or repeat: a row is told by 128 bits of (doc_id, text), and rows
that repeat both repeat all their windows.  An empty table gives an empty
result.  Extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import WordHashes, cut, mix64, row_keys, ship, windows_hash

WIDTH = 35
MER = 6
#: Bits of a minimiser's sketch of distinct strings that split it: its windows are then dealt out singly.
HOT = 64
#: Windows in a super-k-mer at most, and the bits that hold their number: a mask of windows is a long.
MOST, COUNT_BITS = 62, 6
#: Neighbouring windows of a split minimiser that go together while what they have in common is counted.
SPREAD = 6
#: Words that a stretch of whole buckets may hold before it is worked off.
STRETCH_WORDS = 1 << 20
CHUNK_WORDS = 1 << 20


def super_kmers(hashes: np.ndarray, width: int = WIDTH, mer: int = MER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, number of windows and minimiser of each super-k-mer of one document."""
    n = len(hashes) - width + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, np.empty(0, np.uint64)
    g = windows_hash(hashes, mer)
    span = width - mer + 1  # gram places in a window
    at = np.arange(len(g))
    reach = 1
    while reach < span:  # leftmost least over doubled spans
        step = min(reach, span - reach)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(g[right] < g[left], right, left)
        reach += step
    new = np.concatenate(([True], at[1:] != at[:-1]))
    starts = np.flatnonzero(new)
    if span > MOST:  # long runs go in parts, each with the run's minimiser
        since = np.arange(n) - starts[np.cumsum(new) - 1]
        starts = np.flatnonzero(since % MOST == 0)
    return starts, np.diff(np.append(starts, n)), g[at[starts]]


def _word_lists(column) -> Iterator[list[bytes]]:
    for t in column:
        yield (t.as_py() or "").encode().split()


def _packed_words(column) -> Iterator[list[bytes]]:
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for z in column:
        yield unpack(z.as_py()).split()


def compressed(rows: DataFrame) -> DataFrame:
    """(doc_id, k1, k2, text) -> doc_id, k1, k2, z: texts as they are shuffled, at under half their size."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        import pyarrow as pa
        import zstandard

        pack = zstandard.ZstdCompressor(level=3, write_content_size=True, write_checksum=False).compress
        for batch in batches:
            z = [pack((t.as_py() or "").encode()) for t in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(z, pa.binary())], names=["doc_id", "k1", "k2", "z"])

    return rows.select("doc_id", "k1", "k2", "text").mapInArrow(run, f"doc_id {kind}, k1 long, k2 long, z binary")


def listed(rows: DataFrame, width: int) -> DataFrame:
    """(k1, k2, text) -> k1, k2, place, mini, sid, sid2: every super-k-mer by hashes only.

    ``place`` is its first window and, in the low ``COUNT_BITS`` bits, how many it has.
    """

    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        for batch in batches:
            held: list[tuple] = []
            size = 0

            def flush(held=held):
                parts = list(zip(*held, strict=True))
                columns = [np.concatenate(p) for p in parts]
                held.clear()
                return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names=["k1", "k2", "place", "mini", "sid", "sid2"])

            for k1, k2, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), _word_lists(batch.column(2)), strict=True):
                if len(words) < width:
                    continue
                h = known.of(words)
                starts, counts, minis = super_kmers(h, width)
                # the string's hashes from prefix sums of position-weighted words
                sid, sid2 = (_range_hash(x, starts, counts + width - 1) for x in (h, mix64(h + np.uint64(1))))
                held.append((np.full(len(starts), k1), np.full(len(starts), k2), starts << COUNT_BITS | counts, minis, sid, (sid2 >> np.uint64(32)).astype(np.int32)))
                size += len(starts)
                if size >= CHUNK_WORDS // 8:
                    yield flush()
                    size = 0
            if held:
                yield flush()

    return rows.select("k1", "k2", "text").mapInArrow(run, "k1 long, k2 long, place long, mini long, sid long, sid2 int")


_ODD = 0x9E3779B97F4A7C15
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the odd base and of its inverse modulo 2^64, kept for the next document."""
    if len(_POWERS.get("up", ())) <= n:
        size = 1 << max(12, n.bit_length())
        one = np.ones(1, np.uint64)
        with np.errstate(over="ignore"):
            for name, base in (("up", _ODD), ("down", pow(_ODD, -1, 1 << 64))):
                _POWERS[name] = np.concatenate((one, np.cumprod(np.full(size, base, np.uint64), dtype=np.uint64)))
    return _POWERS["up"], _POWERS["down"]


def _range_hash(h: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Hash of h[start : start + length], equal for equal sequences: polynomial prefix sums modulo 2^64, of odd base."""
    n = len(h)
    up, down = _powers(n)
    with np.errstate(over="ignore"):
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(h) * up[:n], dtype=np.uint64, out=prefix[1:])
        part = prefix[starts + lengths] - prefix[starts]
        return mix64(part * down[starts] + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _sent(batches):
    """Words, and places, minimisers and hashes of the strings to send, of every row that sends some."""
    for batch in batches:
        runs = batch.column(4)
        for i in np.flatnonzero(runs.is_valid().to_numpy(zero_copy_only=False)).tolist():
            fields = runs[i].values
            place, mini, sid, sid2, times = (fields.field(k).to_numpy(zero_copy_only=False) for k in range(5))
            yield next(_packed_words(batch.column(3).slice(i, 1))), place >> COUNT_BITS, place & (1 << COUNT_BITS) - 1, (mini, sid, sid2, times)


def packed(senders: DataFrame, width: int) -> DataFrame:
    """(doc_id, k1, k2, z, runs) -> mini, sid, sid2, times, words: the strings to send."""

    def run(batches):
        import pyarrow as pa

        names = ("mini", "sid", "sid2", "times", "words")
        held: list[tuple] = []
        size = 0

        def flush():
            done = pa.RecordBatch.from_arrays([*(pa.array(np.concatenate(c)) for c in list(zip(*held, strict=True))[:4]), pa.array([w for h in held for w in h[4]], pa.string())], names=names)
            held.clear()
            return done

        for words, start, count, tags in _sent(batches):
            strings = [b" ".join(words[a : a + n]).decode() for a, n in zip(start.tolist(), (count + width - 1).tolist(), strict=True)]
            held.append((*tags, strings))
            size += int(count.sum()) + width * len(strings)
            if size >= CHUNK_WORDS // 4:
                yield flush()
                size = 0
        if held:
            yield flush()

    return senders.select("doc_id", "k1", "k2", "z", "runs").mapInArrow(run, "mini long, sid long, sid2 int, times long, words string")


def windows_of(senders: DataFrame, width: int) -> DataFrame:
    """(doc_id, k1, k2, z, runs) -> c1, c2, mini, sid, sid2, times, first, w1, w2: the windows of the strings by their hashes, a few at a time.

    Windows that hold the minimiser at about the same place have ``width + 1 -
    SPREAD`` words in common, which c1 and c2 hash.  Equal windows have equal
    such words, so where those occur once no window repeats.
    """

    def run(batches):
        import pyarrow as pa

        known = WordHashes()
        for words, start, count, tags in _sent(batches):
            # only the words of the strings, one string after the other, are hashed
            sizes = count + width - 1
            h = known.of([w for a, n in zip(start.tolist(), sizes.tolist(), strict=True) for w in words[a : a + n]])
            start = np.cumsum(sizes) - sizes
            grams, span = windows_hash(h, MER).view(np.int64), width - MER + 1
            at = np.array([a + int(np.argmax(grams[a : a + span] == m)) for a, m in zip(start.tolist(), tags[0].tolist(), strict=True)])
            owner = np.repeat(np.arange(len(start)), count)
            offset = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            place = start[owner] + offset
            near = (at[owner] - place) // SPREAD
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (near[1:] != near[:-1]))))
            mine, common = owner[new], at[owner[new]] - near[new] * SPREAD
            out = [tags[0][mine], tags[1][mine], tags[2][mine], tags[3][mine], offset[new].astype(np.int32)]
            ends = np.append(new, len(owner)).astype(np.int32)
            both = (h, mix64(h + np.uint64(1)))
            shared = [mix64(windows_hash(x, width + 1 - SPREAD)[common] + near[new].astype(np.uint64)).view(np.int64) for x in both]
            lists = [pa.ListArray.from_arrays(ends, pa.array(windows_hash(x, width)[place].view(np.int64))) for x in both]
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (*shared, *out)), *lists], names=["c1", "c2", "mini", "sid", "sid2", "times", "first", "w1", "w2"])

    return senders.select("doc_id", "k1", "k2", "z", "runs").mapInArrow(run, "c1 long, c2 long, mini long, sid long, sid2 int, times long, first int, w1 array<long>, w2 array<long>")


def repeated_windows(strings: list[list[bytes]], counts: np.ndarray, width: int) -> list[np.ndarray]:
    """Of each string, the windows that occur again in it, in another, or by its count: exact."""
    lengths = np.array([len(s) for s in strings])
    ids: dict[bytes, int] = {}
    words = np.fromiter((ids.setdefault(w, len(ids)) for s in strings for w in s), np.int64, int(lengths.sum()))
    firsts = np.cumsum(lengths) - lengths
    n_windows = lengths - width + 1
    owner = np.repeat(np.arange(len(strings)), n_windows)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    where = firsts[owner] + place
    key = windows_hash(mix64(words.astype(np.uint64) + np.uint64(1)), width)[where]
    order = np.argsort(key, kind="stable")
    repeat = counts[owner] > 1
    run = np.flatnonzero(key[order][1:] == key[order][:-1])
    # equal hashes stand together; neighbours that are equal word by word are repeats
    a, b = order[run], order[run + 1]
    same = np.ones(len(run), bool)
    for j in range(width):
        same &= words[where[a] + j] == words[where[b] + j]
    repeat[a[same]] = repeat[b[same]] = True
    for k in set(key[order][run[~same]].tolist()):  # a hash that different windows share: compared in full
        group = order[key[order] == k]
        seen: dict[tuple, list[int]] = {}
        for w in group.tolist():
            seen.setdefault(tuple(words[where[w] : where[w] + width].tolist()), []).append(w)
        for members in seen.values():
            if len(members) > 1:
                repeat[members] = True
    ends = np.cumsum(n_windows)
    return [np.flatnonzero(repeat[e - n : e]) for e, n in zip(ends, n_windows, strict=True)]


def counted(strings: DataFrame, width: int) -> DataFrame:
    """(mini, sid, sid2, times, words), dealt and sorted by mini -> (mini, sid, sid2, mask) of strings with repeats: a bit for each window."""

    def run(batches):
        import pyarrow as pa

        held: list[list] = []
        size = 0

        def work():
            found = repeated_windows([x[4] for x in held], np.array([x[3] for x in held]), width)
            some = [i for i, f in enumerate(found) if len(f)]
            mask = [int(np.bitwise_or.reduce(np.int64(1) << found[i].astype(np.int64))) for i in some]
            return pa.RecordBatch.from_arrays([*(pa.array([held[i][k] for i in some], t) for k, t in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))), pa.array(mask, pa.int64())], names=["mini", "sid", "sid2", "mask"])

        for batch in batches:
            for mini, sid, sid2, times, text in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if size >= STRETCH_WORDS and held[-1][0] != mini:
                    yield work()
                    held, size = [], 0
                words = text.encode().split()
                if held and held[-1][:3] == [mini, sid, sid2] and held[-1][4] == words:  # rows that repeat have sent it too
                    continue
                held.append([mini, sid, sid2, times, words])
                size += len(words)
        if held:
            yield work()

    return strings.select("mini", "sid", "sid2", "times", "words").mapInArrow(run, "mini long, sid long, sid2 int, mask long")


def _first_words(hits) -> np.ndarray:
    """First words of the repeated windows, from (place, mask) pairs."""
    place, mask = (hits.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    owner, offset = np.nonzero(mask[:, None] >> np.arange(1 << COUNT_BITS)[None, :] & 1)
    return (place >> COUNT_BITS)[owner] + offset


def without(words: list[bytes], starts: np.ndarray, width: int) -> tuple[list[bytes], int]:
    """Words left, and number removed, when every window that starts at ``starts`` goes."""
    if not len(starts):
        return words, 0
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.asarray(starts) + width, -1)
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k], int((~keep).sum())


def remove_repeats(docs: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", kept_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``) for every row."""
    ship(docs.sparkSession)
    ident, text = F.col(id_col), F.col(text_col).cast("string")
    rows = docs.select(ident.alias("doc_id"), *row_keys(ident, text), text.alias("text"))
    small, string = compressed(rows), ["mini", "sid", "sid2"]
    every = cut(listed(rows, width))  # texts are hashed once, for both uses
    # by hashes alone: minimisers that occur again, and those with many different strings
    sketch = F.expr("bit_or(shiftleft(1L, cast(sid & 63 as int)))")
    minis = every.groupBy("mini").agg(F.count(F.lit(1)).alias("times"), F.bit_count(sketch).alias("bits")).filter("times > 1")
    again = cut(every.join(minis.select("mini", (F.col("bits") >= HOT).alias("hot")), "mini"))
    # one row sends each distinct string
    sender = F.min(F.struct("k1", "k2", "place")).alias("x")
    distinct = again.groupBy(*string, "hot").agg(F.count(F.lit(1)).alias("times"), sender)

    def sending(hot: bool) -> DataFrame:
        """Every row, with the strings it sends.  Always joined alike, so that the texts are shuffled once for all uses."""
        sent = F.collect_list(F.struct(F.col("x.place").alias("place"), *string, "times")).alias("runs")
        runs = distinct.filter(F.col("hot") == hot).groupBy(F.col("x.k1").alias("k1"), F.col("x.k2").alias("k2")).agg(sent)
        return small.join(runs, ["k1", "k2"], "left").select("doc_id", "k1", "k2", "z", "runs")

    cold = counted(packed(sending(False), width).repartition("mini").sortWithinPartitions("mini", "sid", "sid2"), width)
    few = windows_of(sending(True), width)
    common = few.groupBy("c1", "c2").agg(F.sum("times").alias("all")).filter("all > 1").select("c1", "c2")
    each = few.join(common, ["c1", "c2"]).select(*string, "times", "first", F.posexplode(F.arrays_zip("w1", "w2")).alias("at", "w"))
    single = each.select(*string, "times", (F.col("first") + F.col("at")).alias("offset"), "w.w1", "w.w2")
    repeated = single.groupBy("w1", "w2").agg(F.sum("times").alias("all")).filter("all > 1").select("w1", "w2")
    bits = F.bit_or(F.expr("shiftleft(1L, offset)")).alias("mask")
    found = cold.unionByName(single.join(repeated, ["w1", "w2"]).groupBy(*string).agg(bits))
    hits = again.join(found, string).select("k1", "k2", "place", "mask")
    starts = hits.groupBy("k1", "k2").agg(F.collect_set(F.struct("place", "mask")).alias("starts"))
    judged = small.join(starts, ["k1", "k2"], "left").select("doc_id", "z", "starts")
    kind = judged.schema["doc_id"].dataType.simpleString()
    more = ", kept string" if kept_text else ""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            n_words, n_removed, digest, kept = [], [], [], []
            for words, at in zip(_packed_words(batch.column(1)), batch.column(2), strict=True):
                left, gone = without(words, _first_words(at.values) if at.is_valid else np.empty(0, np.int64), width)
                whole = b" ".join(left)
                n_words.append(len(words))
                n_removed.append(gone)
                digest.append(hashlib.sha256(whole).hexdigest())
                if kept_text:
                    kept.append(whole.decode())
            arrays = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if kept_text:
                arrays.append(pa.array(kept, pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return judged.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string{more}")
