"""The objects of JSON arrays of any size, in bounded memory.

A file is read as segments that end at a closing brace, by Spark's text reader,
which splits it at any byte and reads whatever store Spark reads.  Whether a brace
counts depends on all quotes before it, so a range cannot be read alone; but
what a range does to the state is a small function.  From outside and from inside a string,
it has an end (outside or inside) and a change of depth, and these functions
compose.  The first pass finds each range's function, the driver composes them (one
row for each range), and the second pass, knowing where each range begins, cuts
objects.  An object that crosses borders comes in pieces, which are joined.

Rows do not depend on where the ranges are cut.  What stands outside an object
(brackets, commas, numbers) is skipped, as is an object that the file ends within.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright.cluster import ship
from claimwright.operators.graph import _cut

#: A pair that a backslash makes plain, or a character that changes the state.
_STRUCTURE = re.compile(rb'\\.|["{}]', re.DOTALL)


class Effect:
    """What a stretch of bytes does: for each state before it (outside a string, inside one) the change of depth and the least on the way; and whether quotes turn the state over."""

    __slots__ = ("turns", "change", "least")

    def __init__(self, turns: bool = False, change: tuple[int, int] = (0, 0), least: tuple[int, int] = (0, 0)):
        self.turns, self.change, self.least = turns, change, least

    @classmethod
    def of(cls, segments: Iterator[bytes]) -> Effect:
        inside, change, least = 0, [0, 0], [0, 0]
        for segment in segments:
            for m in _STRUCTURE.finditer(segment):
                c = m.group()
                if c == b'"':
                    inside ^= 1
                elif len(c) == 1:
                    # braces count for the state that is outside now
                    change[inside] += 1 if c == b"{" else -1
                    least[inside] = min(least[inside], change[inside])
        return cls(bool(inside), tuple(change), tuple(least))

    def then(self, after: Effect) -> Effect:
        ends = (int(self.turns), 1 - int(self.turns))
        change = tuple(self.change[s] + after.change[ends[s]] for s in (0, 1))
        least = tuple(min(self.least[s], self.change[s] + after.least[ends[s]]) for s in (0, 1))
        return Effect(self.turns != after.turns, change, least)


def objects(segments: Iterator[bytes], inside: bool, depth: int) -> Iterator[tuple[bytes, bool, bool]]:
    """(bytes, begins here, ends here) of each object or piece of one, from a known state."""
    held: list[bytes] = []
    begins = False
    for segment in segments:
        start = 0 if depth > 0 else None
        for m in _STRUCTURE.finditer(segment):
            c = m.group()
            if c == b'"':
                inside = not inside
            elif inside or len(c) > 1:
                continue
            elif c == b"{":
                if depth == 0:
                    start, begins = m.start(), True
                depth += 1
            elif depth > 0:  # a brace too many closes nothing
                depth -= 1
                if depth == 0:
                    held.append(segment[start : m.end()])
                    yield b"".join(held), begins, True
                    held, begins, start = [], False, None
        if start is not None:
            held.append(segment[start:])
    if held:
        yield b"".join(held), begins, False


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """file, size, at (where the range begins), value (up to a closing brace, which is left out)."""
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("at"), F.col("value").cast("binary").alias("value"))


def _by_range(batches) -> Iterator[tuple[tuple, Iterator[bytes]]]:
    """Ranges one after the other, with their segments as they come."""
    import itertools

    def rows():
        for batch in batches:
            yield from zip(*(batch.column(i).to_pylist() for i in range(len(batch.columns) - 1)), (v.as_py() for v in batch.column(batch.num_columns - 1)), strict=True)

    for key, some in itertools.groupby(rows(), key=lambda r: r[:-1]):
        yield key, (r[-1] + b"}" for r in some)


def effects(segments: DataFrame) -> DataFrame:
    """One row for each range: its effect, and the bytes of its segments."""
    names = ("file", "size", "at", "bytes", "turns", "change0", "change1", "least0", "least1")

    def run(batches):
        import pyarrow as pa

        for (file, size, at), some in _by_range(batches):
            count = [0]

            def counted(some=some, count=count):
                for s in some:
                    count[0] += len(s)
                    yield s

            e = Effect.of(counted())
            yield pa.RecordBatch.from_pylist([dict(zip(names, (file, size, at, count[0], e.turns, *e.change, *e.least), strict=True))])

    return segments.mapInArrow(run, "file string, size long, at long, bytes long, turns boolean, change0 long, change1 long, least0 long, least1 long")


def starts(found: list) -> list[tuple]:
    """(file, at, inside, depth, owner, bytes): the state in which each range begins, the range in which the object that is open there began, and the bytes to read."""
    out = []
    files: dict[str, list] = {}
    for r in found:
        files.setdefault(r["file"], []).append(r)
    for file, ranges in files.items():
        state, owner = Effect(), None
        ranges.sort(key=lambda r: r["at"])
        # the last segment has no brace of its own where the file does not end with one
        spare = reduce(lambda n, r: n + r["bytes"], ranges, 0) - ranges[0]["size"]
        for k, r in enumerate(ranges):
            inside, depth = state.turns, state.change[0]
            out.append((file, r["at"], inside, depth, owner if depth > 0 else None, r["bytes"] - (spare if k == len(ranges) - 1 else 0)))
            own = Effect(r["turns"], (r["change0"], r["change1"]), (r["least0"], r["least1"]))
            after = state.then(own)
            if after.change[0] <= 0:
                owner = None
            elif depth <= 0 or depth + own.least[int(inside)] <= 0:
                owner = r["at"]
            state = after
    return out


def array_objects(spark: SparkSession, path: str) -> DataFrame:
    """file, at, n, json: the objects of the arrays in files, in order of (file, at, n).

    ``at`` is the range in which an object begins.
    """
    ship(spark)
    segments = _segments(spark, path)
    state = starts(effects(segments).collect())  # a row for each range
    known = F.broadcast(spark.createDataFrame(state, "__f string, __a long, inside boolean, depth long, owner long, left long"))
    placed = segments.join(known, (F.col("file") == F.col("__f")) & (F.col("at") == F.col("__a")), "left").select("file", "at", "inside", "depth", "owner", "left", "value")

    def run(batches):
        import pyarrow as pa

        names = ("file", "owner", "at", "n", "whole", "last", "body")
        for (file, at, inside, depth, owner, left), some in _by_range(batches):
            def cut(some=some, left=left):
                for s in some:
                    yield s[:left]
                    left -= len(s)

            held, size, n = [], 0, 0
            for body, begins, ends in objects(cut(), inside, depth):
                held.append(dict(zip(names, (file, at if begins else owner, at, n, begins and ends, ends, body), strict=True)))
                n, size = n + 1, size + len(body)
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_pylist(held, schema=schema())
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_pylist(held, schema=schema())

    def schema():
        import pyarrow as pa

        return pa.schema([("file", pa.string()), ("owner", pa.int64()), ("at", pa.int64()), ("n", pa.int64()), ("whole", pa.bool_()), ("last", pa.bool_()), ("body", pa.binary())])

    found = _cut(placed.mapInArrow(run, "file string, owner long, at long, n long, whole boolean, last boolean, body binary"))
    # of an object that crosses borders each range holds one piece
    parts = found.filter("not whole").groupBy("file", "owner").agg(F.array_sort(F.collect_list(F.struct("at", "body"))).alias("p"), F.max("last").alias("done"), F.max(F.when(F.col("at") == F.col("owner"), F.col("n"))).alias("n"))
    joined = parts.filter("done").select("file", F.col("owner").alias("at"), "n", F.aggregate(F.col("p.body"), F.lit(b""), lambda a, b: F.concat(a, b)).alias("body"))
    return found.filter("whole").select("file", "at", "n", "body").unionByName(joined).select("file", "at", "n", F.col("body").cast("string").alias("json"))


def array_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The objects' fields by a schema; what does not parse gives nulls."""
    return array_objects(spark, path).select(F.from_json("json", schema).alias("r")).select("r.*")
