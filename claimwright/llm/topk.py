"""Exact top-k inner-product search by the three-phase uniform threshold method.

Vectors are integers ``floor(64 * x)``; their components are dealt to ``M``
segments, and a candidate's score is the sum of its M segment scores, the M
local lists of the method.  Queries meet all candidates in blocks.

1. Every block takes, per query, the best entries of each segment's sorted list.
   What an entry's segment scores add up to, with the block's least score for
   segments whose list doesn't hold it, is a bound that its score reaches; the k
   best bounds are sent.  The k-th best bound of all blocks is a safe cutoff: k
   candidates reach it.  No full score is computed.
2. The cutoff goes back with the query.  A candidate that reaches ``cutoff``
   has a segment score of at least ``cutoff / M``, so the entries at or above
   this uniform threshold are sufficient.
3. The remaining segment scores of those entries are resolved exactly, and of
   the ones that reach the cutoff each block sends its k best (ties to the
   smaller id), which are ranked.

Nothing is broadcast: query blocks are dealt to groups of candidates by a
shuffle.  Rows are told apart by position, so a row that repeats an id or a
vector is a candidate of its own, and only the query's own row is left out.
Vectors that are null or hold null or non-finite components take no part, nor
do pairs of unequal length.  A null id never is a query and loses ties.
Fewer than k candidates: all are returned.  Extra columns are not carried.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.llm.common import cut, ship

SEGMENTS = 4
CHUNK = 4096
QUERY_CHUNK = 1024
GROUP = 65_536
MIN_GROUPS = 12
NO_ID = np.iinfo(np.int64).max
PACKED = "part int, dim int, n int, ids binary, rids binary, mat binary"


def packed(rows: DataFrame, chunk: int) -> DataFrame:
    """(part, vec_id, rid, embedding) -> chunks of at most ``chunk`` integer vectors of one length and part."""

    def run(batches):
        import pyarrow as pa

        def flush(key, items):
            part, dim = key
            ids, rids = (np.array([x[i] for x in items], np.int64) for i in (0, 1))
            mat = np.stack([x[2] for x in items]) if dim else np.empty((len(items), 0), np.int64)
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in ((part, pa.int32()), (dim, pa.int32()), (len(items), pa.int32()), (ids.tobytes(), pa.binary()), (rids.tobytes(), pa.binary()), (mat.astype(np.int64).tobytes(), pa.binary()))],
                names=["part", "dim", "n", "ids", "rids", "mat"],
            )

        held: dict[tuple[int, int], list] = {}
        waiting = 0
        for batch in batches:
            parts, ids, rids, vectors = (batch.column(i) for i in range(4))
            parts, ids, rids = parts.to_pylist(), ids.to_pylist(), rids.to_pylist()
            offsets, flat = vectors.offsets.to_numpy(), vectors.values
            flat = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null reads as NaN
            whole = np.floor(64 * flat)
            finite = np.isfinite(flat)
            valid = vectors.is_valid().to_numpy(zero_copy_only=False)
            for i in range(batch.num_rows):
                a, b = offsets[i], offsets[i + 1]
                if not valid[i] or not finite[a:b].all():
                    continue
                key = (parts[i], int(b - a))
                items = held.setdefault(key, [])
                items.append((NO_ID if ids[i] is None else ids[i], rids[i], whole[a:b].astype(np.int64)))
                waiting += 1
                if len(items) >= chunk:
                    yield flush(key, held.pop(key))
                    waiting -= chunk
                elif waiting >= 16 * chunk:  # bounds what waits when rows spread over many parts
                    fullest = max(held, key=lambda k: len(held[k]))
                    waiting -= len(held[fullest])
                    yield flush(fullest, held.pop(fullest))
        for key, items in held.items():
            yield flush(key, items)

    return rows.select("part", "vec_id", "rid", "embedding").mapInArrow(run, PACKED)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    top = (np.abs(q).max(initial=0) * 1.0) * (np.abs(c).max(initial=0) * 1.0) * max(1, q.shape[1])
    if top < 2**53:  # exact in doubles, and much faster
        return q.astype(np.float64) @ c.astype(np.float64).T
    return q @ c.T


def _segments(dim: int) -> list[slice]:
    step = max(1, math.ceil(dim / SEGMENTS))
    return [slice(a, min(dim, a + step)) for a in range(0, max(dim, 1), step)]


def _best(qi: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each query, by score and then id."""
    order = np.lexsort((ids, -score, qi))
    first = np.searchsorted(qi[order], qi[order], side="left")
    return order[np.arange(len(order)) - first < k]


def _pairs(batches):
    names = ("q_chunk", "q_ids", "q_rids", "q_mat", "cutoffs", "dim", "ids", "rids", "mat")
    for batch in batches:
        for i in range(batch.num_rows):
            x = {n: batch.column(n)[i].as_py() for n in names if n in batch.schema.names}
            dim = x["dim"]
            q_ids, q_rids, ids, rids = (np.frombuffer(x[n], np.int64) for n in ("q_ids", "q_rids", "ids", "rids"))
            q, c = np.frombuffer(x["q_mat"], np.int64).reshape(len(q_ids), dim), np.frombuffer(x["mat"], np.int64).reshape(len(ids), dim)
            parts = [_scores(q[:, s], c[:, s]) for s in _segments(dim)]
            yield x, q_ids, q_rids, ids, rids, parts


def local_lists(pairs: DataFrame, k: int) -> DataFrame:
    """Phase 1: (q_chunk, qi, score): the k best bounds at most of each block and query."""

    def run(batches):
        import pyarrow as pa

        for x, _, q_rids, ids, rids, parts in _pairs(batches):
            best = min(k + 1, len(ids))  # one more: the query's own row may be among them
            lists = []
            for p in parts:
                held = np.zeros(p.shape, bool)
                np.put_along_axis(held, np.argpartition(-p, best - 1, axis=1)[:, :best], True, axis=1)
                lists.append(held)
            seen = np.logical_or.reduce(lists) & (q_rids[:, None] != rids[None, :])
            qi, ci = np.nonzero(seen)
            score = np.zeros(len(qi), parts[0].dtype)
            for p, held in zip(parts, lists, strict=True):
                score = score + np.where(held[qi, ci], p[qi, ci], p.min(axis=1)[qi])
            keep = _best(qi, score, ids[ci], k)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), x["q_chunk"], np.int64)), pa.array(qi[keep].astype(np.int32)), pa.array(score[keep].astype(np.int64))], names=["q_chunk", "qi", "score"])

    return pairs.mapInArrow(run, "q_chunk long, qi int, score long")


def resolved(pairs: DataFrame, k: int) -> DataFrame:
    """Phases 2 and 3: (q_chunk, qi, query_id, vec_id, score) of entries that reach the cutoff."""

    def run(batches):
        import pyarrow as pa

        for x, q_ids, q_rids, ids, rids, parts in _pairs(batches):
            cutoff = np.full(len(q_ids), -np.inf)
            for c in x["cutoffs"] or ():
                cutoff[c["qi"]] = c["score"]
            sufficient = np.zeros(parts[0].shape, bool)
            for p in parts:
                sufficient |= p >= (cutoff / len(parts))[:, None]
            qi, ci = np.nonzero(sufficient)
            score = np.zeros(len(qi), parts[0].dtype)
            for p in parts:
                score = score + p[qi, ci]
            keep = np.flatnonzero((score >= cutoff[qi]) & (q_rids[qi] != rids[ci]))
            keep = keep[_best(qi[keep], score[keep], ids[ci[keep]], k)]
            qi, ci = qi[keep], ci[keep]
            columns = [np.full(len(keep), x["q_chunk"], np.int64), qi.astype(np.int32), q_ids[qi], ids[ci], score[keep].astype(np.int64)]
            arrays = [pa.array(v) for v in columns]
            arrays[3] = pa.array(ids[ci], mask=ids[ci] == NO_ID)
            yield pa.RecordBatch.from_arrays(arrays, names=["q_chunk", "qi", "query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "q_chunk long, qi int, query_id long, vec_id long, score long")


def exact_top_k(vectors: DataFrame, is_query: Column, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k best of every row for each row where ``is_query`` holds.

    ``is_query`` is a column over ``vec_id``.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    rows = rows.filter("embedding IS NOT NULL").withColumn("rid", F.monotonically_increasing_id())
    n = vectors.count()
    groups = max(MIN_GROUPS, math.ceil(n / GROUP))
    # packed once: positions stay the same however often the blocks are read
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("rid"), F.lit(groups)).cast("int")).withColumn("query", F.coalesce(is_query, F.lit(False)) & F.col("vec_id").isNotNull())
    dealt = cut(dealt)
    candidates = cut(packed(dealt.repartition(groups, "part"), CHUNK))
    n_q = dealt.filter("query").count()
    q_parts = max(1, math.ceil(n_q / QUERY_CHUNK))
    asked = dealt.filter("query").withColumn("part", F.pmod(F.xxhash64("rid", F.lit(1)), F.lit(q_parts)).cast("int"))
    queries = packed(asked.repartition(q_parts, "part"), QUERY_CHUNK).withColumn("q_chunk", F.monotonically_increasing_id())
    queries = cut(queries.select("q_chunk", F.col("dim").alias("q_dim"), F.col("ids").alias("q_ids"), F.col("rids").alias("q_rids"), F.col("mat").alias("q_mat")))

    def paired(queries: DataFrame) -> DataFrame:
        to_all = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        return candidates.join(to_all, (candidates["part"] == to_all["part"]) & (F.col("dim") == F.col("q_dim"))).drop("part", "q_dim", "n")

    by_query = Window.partitionBy("q_chunk", "qi").orderBy(F.col("score").desc())
    lists = local_lists(paired(queries), k)
    cutoffs = lists.withColumn("rn", F.row_number().over(by_query)).filter(F.col("rn") <= k).filter(F.col("rn") == k)
    packed_cutoffs = cutoffs.groupBy("q_chunk").agg(F.collect_list(F.struct("qi", "score")).alias("cutoffs"))  # at most QUERY_CHUNK each
    found = resolved(paired(queries.join(packed_cutoffs, "q_chunk", "left")), k)
    best = Window.partitionBy("q_chunk", "qi").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
