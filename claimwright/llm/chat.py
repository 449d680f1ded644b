"""Chat transcripts to canonical turns by a hidden Markov model.

States are (role, first line) and (role, later line).  A line shows the model
its speaker marker, if any, and a few features; transition and emission
probabilities are counted on a bounded sample of transcripts with known roles.
The Viterbi path recovers roles where markers are missing, and each turn is
rendered as ``<|role|>`` and its lines without markers.

A transcript may be of any length, so its lines are numbered by ranges and it
is cut into chunks of ``span`` lines.  Each chunk gives the matrix of best path scores from any
state before it to any state at its end; products of such matrices (maximum for
sum) combine ``FAN`` chunks at a time until one is left for each transcript,
and the best path then goes down the same tree: the states at chunk borders
first, the lines of every chunk last.  The path is that of the whole
transcript, and no task sees more than one chunk or ``FAN`` matrices.  A turn
that crosses a chunk border is given in parts, later ones marked
``continued``.

Nulls: a null line is an empty one; null transcript ids make a transcript of
their own, of any size; null sequence numbers come first.  Lines that share a sequence number are
ordered by their text.  In transcripts of a turn table, turns of one number come one after the
other whole, by a hash of role and text, null turns (whose ``seq`` is null) before all others.
Ties go to the first role.  An empty table gives an
empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimwright.llm.common import cut, numbered_copies, ship
from claimwright.operators.stats import ranked

ROLES = ("system", "user", "assistant")
#: Marker -> role; a marker is at the start of a line, in any case, and may be bracketed or followed by a colon.
MARKERS = {"system": ("system", "instructions"), "user": ("user", "human", "q"), "assistant": ("assistant", "ai", "bot", "a")}
#: Chunks that the model is fitted on, at most about so many.
SAMPLE_CHUNKS = 2_000
FAN = 64
#: Lines in a chunk.
SPAN = 64
STATES = 2 * len(ROLES)
SYMBOLS = (len(ROLES) + 1) * 8


def _marker(words: tuple[str, ...]) -> str:
    names = "|".join(words)
    return rf"(?i)^\s*(?:<\|(?:{names})\|>|\[(?:{names})\]|#+\s*(?:{names})\s*:|(?:{names})\s*:)\s*"


def observed(line: Column) -> Column:
    """Symbol of a line: its marker, and whether the rest is empty, starts in upper case and ends a sentence."""
    marker = F.lit(0)
    for i, role in enumerate(ROLES):
        marker = F.when(line.rlike(_marker(MARKERS[role])), F.lit(i + 1)).otherwise(marker)
    rest = unmarked(line)
    flags = (F.trim(rest) == "").cast("int") * 4 + rest.rlike(r"^\s*\p{Lu}").cast("int") * 2 + rest.rlike(r"[.?!]\s*$").cast("int")
    return (marker * 8 + flags).cast("int")


def unmarked(line: Column) -> Column:
    return F.regexp_replace(line, _marker(tuple(w for r in ROLES for w in MARKERS[r])), "")


#: Columns that order the lines of a turn table, and the number that any line gets.
_TURN = ["__turn", "__row", "__copy", "__pos"]
_AT = "__at"


def numbered(lines: DataFrame, span: int) -> DataFrame:
    """``lines`` with ``chunk``: ``span`` lines each in their order, however long a transcript is."""
    order = _TURN if _TURN[0] in lines.columns else ["seq", "line"]
    place = ranked(lines, ["conv_id"], *order, out=_AT)
    return place.withColumn("chunk", F.floor((F.col(_AT) - 1) / span).cast("long"))


def fit(labelled: DataFrame) -> dict[str, np.ndarray]:
    """Log probabilities from ``numbered`` lines (with role, first) of transcripts with known roles: a hash-chosen sample of about SAMPLE_CHUNKS chunks."""
    n = labelled.agg(F.approx_count_distinct(F.struct("conv_id", "chunk"))).first()[0] or 0
    one_in = max(1, math.ceil(n / SAMPLE_CHUNKS))
    sample = labelled.filter(F.pmod(F.xxhash64(F.col("conv_id"), F.col("chunk"), F.lit("chat")), F.lit(one_in)) == 0)
    role = F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")).cast("int") - 1
    state = role * 2 + F.when(F.col("first"), 0).otherwise(1)
    known = sample.withColumn("state", state).filter("state >= 0").withColumn("obs", observed(F.coalesce("line", F.lit(""))))
    before = F.lag("state").over(Window.partitionBy("conv_id", "chunk").orderBy(_AT))
    moves = known.withColumn("before", before).withColumn("lead", (F.col("chunk") == 0) & F.col("before").isNull())
    rows = moves.groupBy("before", "state", "obs", "lead").count().collect()  # at most (STATES + 2) * STATES * SYMBOLS rows
    start, move, emit = np.full(STATES, 0.1), np.full((STATES, STATES), 0.1), np.full((STATES, SYMBOLS), 0.1)
    for r in rows:
        emit[r["state"], r["obs"]] += r["count"]
        if r["before"] is not None:
            move[r["before"], r["state"]] += r["count"]
        elif r["lead"]:
            start[r["state"]] += r["count"]
    start[1::2] = 1e-9  # a transcript, and a role after another, begin with a first line
    for i in range(STATES):
        for j in range(1, STATES, 2):
            if i // 2 != j // 2:
                move[i, j] = 1e-9
    return {"start": np.log(start / start.sum()), "move": np.log(move / move.sum(axis=1, keepdims=True)), "emit": np.log(emit / emit.sum(axis=1, keepdims=True))}


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def _steps(model: dict[str, np.ndarray], obs: list[int], first: bool) -> list[np.ndarray]:
    """Score matrix of each line: from the state before (any, for the transcript's first line) to its own."""
    steps = [model["move"] + model["emit"][None, :, o] for o in obs]
    if first and steps:
        steps[0] = np.broadcast_to(model["start"] + model["emit"][:, obs[0]], (STATES, STATES)).copy()
    return steps


def _path(mats: list[np.ndarray], before: int, end: int) -> list[int]:
    """States after each matrix on the best path from ``before`` to ``end`` (-1: the best one)."""
    score, back = mats[0][before], []
    for m in mats[1:]:
        through = score[:, None] + m
        back.append(through.argmax(axis=0))
        score = through.max(axis=0)
    at = int(score.argmax()) if end < 0 else end
    out = [at]
    for b in reversed(back):
        at = int(b[at])
        out.append(at)
    return out[::-1]


def _matrices(chunks: DataFrame, model: dict[str, np.ndarray]) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            mats = []
            for first, obs in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                total = None
                for m in _steps(model, obs, first):
                    total = m if total is None else _times(total, m)
                mats.append(total.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mats, pa.binary())], names=["conv_id", "idx", "mat"])

    kind = chunks.schema["conv_id"].dataType.simpleString()
    return chunks.select("conv_id", F.col("chunk").alias("idx"), "first", F.transform("lines", lambda x: x["obs"]).alias("obs")).mapInArrow(run, f"conv_id {kind}, idx long, mat binary")


def _grouped(level: DataFrame) -> DataFrame:
    """FAN neighbouring matrices each, in order: at most FAN rows a group."""
    own = F.array_sort(F.collect_list(F.struct("idx", "mat")))
    return level.groupBy("conv_id", F.floor(F.col("idx") / FAN).cast("long").alias("up")).agg(own.alias("parts"))


def _combined(level: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            mats = []
            for parts in batch.column(2).to_pylist():
                total = None
                for p in parts:
                    m = np.frombuffer(p["mat"]).reshape(STATES, STATES)
                    total = m if total is None else _times(total, m)
                mats.append(total.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(mats, pa.binary())], names=["conv_id", "idx", "mat"])

    kind = level.schema["conv_id"].dataType.simpleString()
    return _grouped(level).mapInArrow(run, f"conv_id {kind}, idx long, mat binary")


def _bordered(level: DataFrame, above: DataFrame | None) -> DataFrame:
    """(conv_id, idx, before, end) of each part, from the borders of its group (None: the best path from the start)."""
    groups = _grouped(level)
    if above is None:
        groups = groups.withColumn("before", F.lit(0)).withColumn("end", F.lit(-1))
    else:
        theirs = above.withColumnsRenamed({"conv_id": "__c", "idx": "__i"})
        groups = groups.join(theirs, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("up") == F.col("__i")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            conv, idx, befores, ends = [], [], [], []
            for k, (parts, before, end) in enumerate(zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True)):
                path = _path([np.frombuffer(p["mat"]).reshape(STATES, STATES) for p in parts], before, end)
                conv += [k] * len(parts)
                idx += [p["idx"] for p in parts]
                befores += [before, *path[:-1]]
                ends += path
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(conv, pa.int64())), pa.array(idx, pa.int64()), pa.array(befores, pa.int32()), pa.array(ends, pa.int32())], names=["conv_id", "idx", "before", "end"])

    kind = level.schema["conv_id"].dataType.simpleString()
    return groups.select("conv_id", "parts", "before", "end").mapInArrow(run, f"conv_id {kind}, idx long, before int, end int")


def parse_transcripts(lines: DataFrame, model: dict[str, np.ndarray], *, conv_col: str = "conv_id", seq_col: str = "seq", line_col: str = "line", span: int = SPAN) -> DataFrame:
    """conv_id, seq (of a turn's first line), role, n_lines, continued, rendered: one row for each recovered turn.

    Lines that are ``numbered`` already keep their chunks.  ``seq`` is the line's own.
    """
    ship(lines.sparkSession)
    line = F.coalesce(F.col(line_col).cast("string"), F.lit(""))
    known = [_AT, "chunk"] if _AT in lines.columns else []
    order = [c for c in _TURN if c in lines.columns]
    plain = lines.select(F.col(conv_col).alias("conv_id"), F.col(seq_col).cast("long").alias("seq"), line.alias("line"), *known, *order)
    plain = plain if known else numbered(plain, span)
    rows = plain.select("conv_id", "seq", "chunk", F.col(_AT).alias("at"), observed(F.col("line")).alias("obs"), unmarked(F.col("line")).alias("line"))
    parts = rows.groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "line", "obs"))).alias("lines"))
    firsts = rows.groupBy("conv_id").agg(F.min("chunk").alias("__first")).withColumnRenamed("conv_id", "__c")
    chunks = cut(parts.join(firsts, F.col("conv_id").eqNullSafe(F.col("__c"))).select("conv_id", "chunk", (F.col("chunk") == F.col("__first")).alias("first"), "lines"))
    levels = [cut(_matrices(chunks, model))]
    while (levels[-1].agg(F.max("idx")).first()[0] or 0) >= FAN:
        levels.append(cut(_combined(levels[-1])))
    borders: DataFrame | None = None
    for level in reversed(levels):
        borders = _bordered(level, borders)
    theirs = borders.select(F.col("conv_id").alias("__c"), F.col("idx").alias("__i"), "before", "end")
    both = chunks.join(theirs, F.col("conv_id").eqNullSafe(F.col("__c")) & (F.col("chunk") == F.col("__i")))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at, seqs, roles, counts, continued, rendered = [], [], [], [], [], []
            for k in range(batch.num_rows):
                first, items, before, end = (batch.column(i)[k].as_py() for i in range(1, 5))
                path = _path(_steps(model, [x["obs"] for x in items], first), before, end)
                held: list[str] = []
                for j, (x, state) in enumerate(zip(items, path, strict=True)):
                    begins = state % 2 == 0
                    if begins or j == 0:
                        at.append(k)
                        seqs.append(x["seq"])
                        roles.append(ROLES[state // 2])
                        counts.append(0)
                        continued.append(not begins)
                        held.append([])
                    counts[-1] += 1
                    held[-1].append(x["line"])
                n = len(held)
                rendered += [f"<|{r}|>\n" + "\n".join(h) for r, h in zip(roles[len(roles) - n :], held, strict=True)]
            columns = [batch.column(0).take(pa.array(at, pa.int64())), pa.array(seqs, pa.int64()), pa.array(roles, pa.string()), pa.array(counts, pa.int32()), pa.array(continued, pa.bool_()), pa.array(rendered, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "seq", "role", "n_lines", "continued", "rendered"])

    kind = chunks.schema["conv_id"].dataType.simpleString()
    return both.select("conv_id", "first", "lines", "before", "end").mapInArrow(run, f"conv_id {kind}, seq long, role string, n_lines int, continued boolean, rendered string")


#: In a transcript made of a turn table, a turn's lines have this many sequence numbers: a line has a character at least.
TURN_LINES = 1 << 31


def transcript_of(turns: DataFrame) -> DataFrame:
    """Lines (conv_id, seq, line, role, first) of the transcripts that ``conversations`` would have been scraped from.

    A transcript writes its speakers in one of four styles; one turn in eight
    lost its marker (both by hash).
    """
    style = F.pmod(F.xxhash64("conv_id", F.lit("style")), F.lit(4))
    lost = F.pmod(F.xxhash64("conv_id", "turn", F.lit("lost")), F.lit(8)) == 0
    role = F.coalesce(F.col("role").cast("string"), F.lit("user"))
    name = F.when(style == 1, F.when(role == "user", F.lit("Human")).when(role == "assistant", F.lit("AI")).otherwise(F.initcap(role))).otherwise(role)
    marker = F.when(lost, F.lit("")).when(style == 0, F.concat(F.initcap(role), F.lit(": "))).when(style == 1, F.concat(name, F.lit(": "))).when(style == 2, F.concat(F.lit("### "), F.initcap(role), F.lit(": "))).otherwise(F.concat(F.lit("<|"), role, F.lit("|> ")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    named = turns.select("conv_id", F.col("turn").cast("long").alias("__turn"), role.alias("role"), text.alias("text"), F.concat(marker, text).alias("marked"))
    # rows that repeat are turns of their own
    named = numbered_copies(named.withColumn("__row", F.xxhash64("role", "text")), ["conv_id", "__turn", "role", "text"], "__copy")
    each = named.select("conv_id", "__turn", "__row", "__copy", "role", F.posexplode(F.split("marked", "\n")).alias("__pos", "line"))
    seq = F.try_add(F.try_multiply(F.col("__turn"), F.lit(TURN_LINES)), F.col("__pos"))
    return each.select("conv_id", seq.alias("seq"), "line", "role", (F.col("__pos") == 0).alias("first"), *_TURN)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Canonical turns of the transcripts of a turn table."""
    ship(turns.sparkSession)
    lines = numbered(transcript_of(turns), SPAN)
    return parse_transcripts(lines, fit(lines))
