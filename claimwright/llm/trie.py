"""Prefix trie of conversations in succinct level-order form.

A node is a distinct sequence of first turns (role and text).  Turns become 128
bits and a word count at once, so texts are shuffled for their order and no further.  A prefix's
key is the exclusive or of the hashes of its (depth, turn) pairs: the rows of one
conversation may lie in any number of partitions, each scans its own, and what
one partition hands the next is a row.

Nodes with many rows below them (``HEAVY``) are the upper levels.  Every
largest subtree below those has at most that many nodes; whole subtrees are
dealt to shards, and each shard is a LOUDS trie built with numpy: a bit vector of child counts in
level order and arrays of labels.  Rollups go over its levels in reverse with
``add.at``.  Sums of the subtrees then meet in the upper levels, which are added
up by doubling the distance to an ancestor, so a path of any length takes the
logarithm of it in rounds.

Nulls: a null turn comes first, a null role or text is empty; turns with a null
conversation belong to none and are left out.  Turns that tie are ordered by role, then text;
repeated rows are turns of their own.  An empty table gives no rows.  Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimwright.llm.common import cut, cut_counted, ship, small_or_shuffled

#: Rows below a node of the upper levels, more than these.
HEAVY = 8192
#: Nodes that a shard has on average, about.
SHARD_NODES = 16_384
#: Keys of the upper levels are broadcast up to this many rows of 20 bytes.
BROADCAST_ROWS = 50_000
#: Depths, and conversation ids, of one piece where a long conversation or a group of copies is split.
PIECE_BITS = 12
#: Conversations of one block share the opening of its first.
BLOCK, OPENING = 20, 4
#: Characters of a role or text by which ranges are told; the sort goes by the whole.
RANGE_CHARS = 64
WORD = r"[^\x20\x09-\x0D]+"
KEY = ["depth", "k1", "k2"]


def _runs(c: np.ndarray) -> np.ndarray:
    """Where the run of equal values that each place belongs to begins."""
    starts = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
    return np.repeat(starts, np.diff(np.r_[starts, len(c)]))


def _scanned(rows: DataFrame, out: str, step: Callable, start: tuple) -> DataFrame:
    """A running value of each conversation over rows in order, told by partition: adds ``part`` and the columns ``out``.

    ``step(batch, begins, carried, same)`` gives the columns of a batch and the
    value after its last row; ``carried`` is the value before it, for the rows that go on with it.
    """
    names = rows.columns

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, last, carried = TaskContext.get().partitionId(), None, start
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(0).to_numpy()
            begins = _runs(c)
            on = (begins == 0) & (c[0] == last)
            columns, carried = step(batch, begins, carried, on)
            last = c[-1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(c), part, np.int32)), *map(pa.array, columns)], names=[*names, "part", *out_names])

    out_names = [x.split()[0] for x in out.split(", ")]
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return cut(rows.mapInArrow(run, f"{kinds}, part int, {out}"))


def _carries(scanned: DataFrame, values: list[str], add: Callable[[tuple, tuple], tuple], start: tuple) -> DataFrame | None:
    """part, conv_id and what the parts before it hold of that conversation; None where none goes on.

    The driver sees one row for each partition.
    """
    ends = scanned.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", "place", *values)).alias("last")).collect()
    found, before, held = [], None, start
    for r in sorted(ends, key=lambda r: r.part):
        carry = held if r["first"] == before else start
        if carry != start:
            found.append((r.part, r["first"], *carry))
        own = tuple(r["last"][v] for v in values)
        held = add(carry, own) if r["first"] == r["last"]["conv_id"] else own
        before = r["last"]["conv_id"]
    if not found:
        return None
    return scanned.sparkSession.createDataFrame(found, "part int, conv_id long, " + ", ".join(f"__{v} long" for v in values))


def _carried(scanned: DataFrame, values: list[str], add: Callable, combined: Callable[[Column, Column], Column], start: tuple) -> DataFrame:
    carries = _carries(scanned, values, add, start)
    names = [c for c in scanned.columns if c not in (*values, "part")]
    if carries is None:
        return scanned.select(*names, *values)
    both = scanned.join(F.broadcast(carries), ["part", "conv_id"], "left")  # one row for each partition at most
    return both.select(*names, *(combined(F.col(v), F.coalesce(f"__{v}", F.lit(0).cast("long"))).alias(v) for v in values))


def _placed(rows: DataFrame) -> DataFrame:
    """Rows that are in the order of conv_id, with ``place`` in their conversation from 1."""

    def step(batch, begins, carried, on):
        place = np.arange(len(begins)) - begins + 1
        place[on] += carried[0]
        return [place], (int(place[-1]),)

    return _carried(_scanned(rows, "place long", step, (0,)), ["place"], lambda a, b: (a[0] + b[0],), lambda a, b: a + b, (0,))


def ordered_turns(turns: DataFrame) -> DataFrame:
    """conv_id, l1, l2 (128 bits of role and text), words, place (from 1, in the conversation)."""
    ship(turns.sparkSession)
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    known = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    short = F.length("role") <= RANGE_CHARS
    dealt = known.repartitionByRange("conv_id", "turn", F.left("role", F.lit(RANGE_CHARS)), F.when(short, F.left("text", F.lit(RANGE_CHARS))).otherwise(""))
    words = F.regexp_count("text", F.lit(WORD)).cast("long")
    labels = [F.xxhash64(F.lit(k), "role", "text").alias(f"l{k}") for k in (1, 2)]
    return _placed(dealt.sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", *labels, words.alias("words")))


def opening_length(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % OPENING


def with_shared_openings(ordered: DataFrame, ids: DataFrame) -> DataFrame:
    """Each conversation begins with the first turns of its block's first one and goes on with its own after as many."""
    own = ordered.filter(F.col("place") > opening_length(F.col("conv_id"))).withColumn("own", F.lit(1))
    near = F.explode(F.transform(F.sequence(F.lit(1 - BLOCK), F.lit(BLOCK - 1)), lambda d: F.try_add(F.col("conv_id"), d.cast("long"))))
    heads = ordered.filter((F.col("place") < OPENING) & (F.col("conv_id") % BLOCK == 0)).withColumn("to", near)
    heads = heads.filter((F.col("to") - F.col("to") % BLOCK == F.col("conv_id")) & (F.col("place") <= opening_length(F.col("to"))))
    given = heads.select(F.col("to").alias("conv_id"), "l1", "l2", "words", "place", F.lit(0).alias("own")).join(ids, "conv_id", "left_semi")
    both = given.unionByName(own)
    order = ["conv_id", "own", "place"]
    return _placed(both.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "l1", "l2", "words"))


def prefixed(placed: DataFrame) -> DataFrame:
    """conv_id, depth, k1, k2 (of the prefix), p1, p2 (of the one before), words."""
    hashed = placed.select("conv_id", "place", "words", *(F.xxhash64(F.lit(k), "place", "l1", "l2").alias(f"v{k}") for k in (1, 2)))

    def step(batch, begins, carried, on):
        out, after = [], []
        for value, before in zip(batch.columns[3:5], carried, strict=True):
            x = np.bitwise_xor.accumulate(value.to_numpy())
            x ^= np.where(begins > 0, x[begins - 1], 0)
            x[on] ^= before
            out.append(x)
            after.append(int(x[-1]))
        return out, tuple(after)

    scanned = _scanned(hashed, "x1 long, x2 long", step, (0, 0))
    keyed = _carried(scanned, ["x1", "x2"], lambda a, b: (a[0] ^ b[0], a[1] ^ b[1]), lambda a, b: a.bitwiseXOR(b), (0, 0))
    return keyed.select("conv_id", F.col("place").alias("depth"), F.col("x1").alias("k1"), F.col("x2").alias("k2"), *(F.col(f"x{k}").bitwiseXOR(F.col(f"v{k}")).alias(f"p{k}") for k in (1, 2)), "words")


def with_length(rows: DataFrame) -> DataFrame:
    """``rows`` with the length of their conversation, which meets a long one's rows by pieces."""
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("length"))
    pieces = lengths.select("conv_id", "length", F.explode(F.sequence(F.lit(0).cast("long"), _piece(F.col("length")))).alias("piece"))
    return rows.withColumn("piece", _piece(F.col("depth"))).join(pieces, ["conv_id", "piece"]).drop("piece")


def _piece(x: Column) -> Column:
    return F.shiftright(x, PIECE_BITS)


def ends_digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256 of the ids (conv_id) of each node, ascending, joined by commas.

    Ids are sorted and joined by pieces of ``2 ** PIECE_BITS`` values; a node's pieces then
    go through one hash in order, never held together.
    """
    joined = ends.groupBy(*KEY, _piece(F.col("conv_id")).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        import pyarrow as pa

        key, state, keys, digests = None, None, [], []
        for batch in batches:
            for *now, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != key:
                    if key is not None:
                        keys.append(key)
                        digests.append(state.hexdigest())
                    key, state = now, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield told(pa, keys, digests)
            keys, digests = [], []
        if key is not None:
            yield told(pa, [key], [state.hexdigest()])

    def told(pa, keys, digests):
        columns = [pa.array([k[i] for k in keys], pa.int64()) for i in range(3)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(digests, pa.string())], names=[*KEY, "ends_sha256"])

    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "piece").mapInArrow(run, "depth long, k1 long, k2 long, ends_sha256 string")


# ---- shards ----------------------------------------------------------------------------------------
LABELS = ("depth", "k1", "k2", "p1", "p2", "conv_id", "n_convs", "words")
TRIE = "shard int, nodes long, louds binary, " + ", ".join(f"{c} array<bigint>" for c in LABELS)
ROLLED = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, top boolean, parent_conv_id long, n_children long, n_leaves long, saved_tokens long"


def level_order(columns: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the nodes in level order, and child counts in that order behind those of a node above all tops."""
    n = len(columns["depth"])
    keys = np.empty(n, dtype=[("depth", np.int64), ("k1", np.int64), ("k2", np.int64)])
    above = np.empty_like(keys)
    keys["depth"], keys["k1"], keys["k2"] = columns["depth"], columns["k1"], columns["k2"]
    above["depth"], above["k1"], above["k2"] = columns["depth"] - 1, columns["p1"], columns["p2"]
    by = np.lexsort((keys["k2"], keys["k1"], keys["depth"]))
    at = np.searchsorted(keys[by], above)
    found = at < n
    found[found] = keys[by][at[found]] == above[found]
    parent = np.where(found, by[np.minimum(at, n - 1)], -1)
    place = np.full(n + 1, -1)  # in level order; of -1, the node above all: 0
    place[-1] = 0
    level, order, held = np.array([-1]), [], 1
    below = np.argsort(parent, kind="stable")
    starts = np.searchsorted(parent[below], np.arange(-1, n + 1))  # of node i's children: starts[i + 1]
    degree = np.diff(starts)
    counts = []
    while len(level):
        d = degree[level + 1]
        counts.append(d)
        # the children of a level's nodes, node by node
        firsts = np.repeat(starts[level + 1] - np.r_[0, np.cumsum(d)[:-1]], d)
        children = below[firsts + np.arange(d.sum())]
        place[children] = held + np.arange(len(children))
        held += len(children)
        order.append(children)
        level = children
    return np.concatenate(order), np.concatenate(counts)


def louds_bits(degrees: np.ndarray) -> np.ndarray:
    """A one for each child and a zero behind each node's, in level order."""
    bits = np.ones(int(degrees.sum()) + len(degrees), np.uint8)
    bits[np.cumsum(degrees + 1) - 1] = 0
    return bits


def parents_and_degrees(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of nodes 1..n: the parent is the number of zeros before the node's one; and child counts of nodes 0..n."""
    zeros = np.cumsum(bits == 0)
    ends = np.flatnonzero(bits == 0)
    return zeros[bits == 1], np.diff(np.r_[-1, ends]) - 1


def shard_tries(nodes: DataFrame) -> DataFrame:
    """One LOUDS trie a shard: ``louds`` (packed bits) and arrays of labels in level order."""

    def build(table):
        import pyarrow as pa

        columns = {c: table.column(c).to_numpy() for c in LABELS}
        order, degrees = level_order(columns)
        out = {"shard": pa.array([table.column("shard")[0].as_py()], pa.int32()), "nodes": pa.array([len(order)], pa.int64()), "louds": pa.array([np.packbits(louds_bits(degrees)).tobytes()], pa.binary())}
        for c in LABELS:
            out[c] = pa.array([columns[c][order]], pa.list_(pa.int64()))
        return pa.table(out)

    return nodes.select("shard", *(F.col(c).cast("long") for c in LABELS)).groupBy("shard").applyInArrow(build, TRIE)


def rolled_up(tries: DataFrame) -> DataFrame:
    """A row for each node of the tries; ``top`` nodes have their parents in the upper levels."""

    def run(batches) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for k in range(batch.num_rows):
                of = {c: batch.column(batch.schema.get_field_index(c))[k] for c in ("nodes", "louds", *LABELS)}
                n = of["nodes"].as_py()
                label = {c: of[c].values.to_numpy() for c in LABELS}
                parent, degree = parents_and_degrees(np.unpackbits(np.frombuffer(of["louds"].as_py(), np.uint8))[: 2 * n + 1])
                leaves = np.r_[0, (degree[1:] == 0).astype(np.int64)]
                saved = np.r_[0, (label["n_convs"] - 1) * label["words"]]
                levels, at = [], np.array([0, 1])
                while at[0] < at[1]:
                    at = np.array([at[1], at[1] + degree[at[0] : at[1]].sum()])
                    levels.append(slice(*at))
                for level in reversed(levels):
                    up = parent[level.start - 1 : level.stop - 1]
                    np.add.at(leaves, up, leaves[level])
                    np.add.at(saved, up, saved[level])
                top = parent == 0
                above = pa.array(np.r_[0, label["conv_id"]][parent], mask=top)
                columns = [*(pa.array(label[c]) for c in LABELS[:-1]), pa.array(top), above, *(pa.array(x[1:].astype(np.int64)) for x in (degree, leaves, saved))]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in ROLLED.split(", ")])

    return tries.mapInArrow(run, ROLLED)


# ---- upper levels ----------------------------------------------------------------------------------
def _parents(rows: DataFrame, *more: Column | str) -> DataFrame:
    return rows.select((F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2"), *more)


def upper_sums(heavy: DataFrame, tops: DataFrame) -> DataFrame:
    """The ``heavy`` nodes with n_children, n_leaves and saved_tokens of their subtrees."""
    parts = _parents(tops, F.lit(1).alias("c"), "n_leaves", "saved_tokens").union(_parents(heavy, F.lit(1), F.lit(0).cast("long"), F.lit(0).cast("long")))
    base = parts.groupBy(*KEY).agg(F.sum("c").cast("long").alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    own = (F.col("n_convs") - 1) * F.col("words")
    known = cut(heavy.join(base, KEY).withColumn("saved_tokens", F.col("saved_tokens") + own))
    root = F.col("depth") == 0
    sums = known.select(*KEY, "n_leaves", "saved_tokens", *(F.when(~root, F.col(p)).alias(f"j{k}") for k, p in ((1, "p1"), (2, "p2"))), F.when(~root, F.col("depth") - 1).alias("j0"))
    far = heavy.agg(F.max("depth")).first()[0]
    reach = 1
    while reach <= far:  # every node holds the sums of what is less than ``reach`` below it
        given = sums.filter("j0 is not null").groupBy(F.col("j0").alias("depth"), F.col("j1").alias("k1"), F.col("j2").alias("k2")).agg(F.sum("n_leaves").alias("__l"), F.sum("saved_tokens").alias("__s"))
        on = sums.select(F.col("depth").alias("j0"), F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("j0").alias("__0"), F.col("j1").alias("__1"), F.col("j2").alias("__2"))
        more = sums.join(given, KEY, "left").join(on, ["j0", "j1", "j2"], "left")
        zero = F.lit(0).cast("long")
        sums = cut(more.select(*KEY, (F.col("n_leaves") + F.coalesce("__l", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("__s", zero)).alias("saved_tokens"), F.col("__1").alias("j1"), F.col("__2").alias("j2"), F.col("__0").alias("j0")))
        reach *= 2
    return known.drop("n_leaves", "saved_tokens").join(sums.select(*KEY, "n_leaves", "saved_tokens"), KEY)


def prefix_trie(rows: DataFrame, ids: DataFrame, heavy_rows: int = HEAVY, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """A row for each node: KEY, conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``rows`` are ``prefixed``; ``ids`` holds every conversation once, those without turns too.
    """
    rows, n_rows = cut_counted(with_length(rows))
    n_ids, least = ids.agg(F.count(F.lit(1)), F.min("conv_id")).first()
    spark = rows.sparkSession
    below = F.sum(F.col("length") - F.col("depth")).alias("below")
    nodes = rows.groupBy(*KEY).agg(F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), below)
    root = spark.createDataFrame([(0, 0, 0, 0, 0, least, n_ids, 0, n_rows)] if n_ids else [], "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, n_convs long, words long, below long")
    nodes, n_nodes = cut_counted(nodes.unionByName(root))
    heavy, light = (nodes.filter(c) for c in (F.col("below") > heavy_rows, F.col("below") <= heavy_rows))
    n_heavy = heavy.count()
    if n_heavy:
        keys = small_or_shuffled(heavy.select(*KEY), n_heavy, BROADCAST_ROWS)
        # where each conversation leaves the upper levels: all it passes below is in one subtree
        left = rows.join(keys, KEY, "left_anti").groupBy("conv_id", "length").agg(F.min(F.struct(*KEY)).alias("top"))
        pieces = left.select("conv_id", "top", F.explode(F.sequence(_piece(F.col("top.depth")), _piece(F.col("length")))).alias("piece"))
        shards = max(1, n_nodes // shard_nodes)
        dealt = light.withColumn("piece", _piece(F.col("depth"))).join(pieces, ["conv_id", "piece"]).withColumn("shard", F.pmod(F.xxhash64("top"), F.lit(shards)).cast("int"))
    else:
        dealt = light.withColumn("shard", F.lit(0))
    rolled = rolled_up(shard_tries(dealt))
    wanted = [*KEY, "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    if n_heavy:
        rolled = cut(rolled)
        upper = upper_sums(heavy, rolled.filter("top"))
        ids_of = small_or_shuffled(_renamed(heavy), n_heavy, BROADCAST_ROWS)
        tops = rolled.filter("top").drop("parent_conv_id").unionByName(upper.select(*(c for c in rolled.columns if c not in ("parent_conv_id", "top"))).withColumn("top", F.lit(True)))
        known = _above(tops, ids_of)
        rolled = rolled.filter("not top").select(*wanted).unionByName(known.select(*wanted))
    ended = rows.filter(F.col("depth") == F.col("length")).select(*KEY, "conv_id")
    silent = ids.join(rows.filter("depth = 1").select("conv_id"), "conv_id", "left_anti")
    ends = ends_digests(ended.unionByName(silent.select(*(F.lit(0).cast("long").alias(k) for k in KEY), "conv_id")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return rolled.select(*wanted).join(ends, KEY, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing))


def _renamed(heavy: DataFrame) -> DataFrame:
    return heavy.select(F.col("depth").alias("__d"), F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("conv_id").alias("parent_conv_id"))


def _above(nodes: DataFrame, ids_of: DataFrame) -> DataFrame:
    return nodes.join(ids_of, (F.col("depth") - 1 == F.col("__d")) & (F.col("p1") == F.col("__k1")) & (F.col("p2") == F.col("__k2")), "left")


def conversation_trie(turns: DataFrame, *, shared_openings: bool = False, heavy_rows: int = HEAVY, shard_nodes: int = SHARD_NODES) -> DataFrame:
    """``prefix_trie`` of a turn table (conv_id, turn, role, text)."""
    ordered = ordered_turns(turns)
    ids = cut(ordered.groupBy("conv_id").agg(F.lit(1).alias("one")).select("conv_id"))
    placed = with_shared_openings(ordered, ids) if shared_openings else ordered
    return prefix_trie(prefixed(placed), ids, heavy_rows, shard_nodes)
