"""Ownership graphs at a date: edges, path products, expansion, components."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimwright import schemas as S


def shared_folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a temporary one only where it is unset and all runs in one process."""
    sc = spark.sparkContext
    there = sc.getCheckpointDir()
    if there is None:
        there = spark.conf.get("spark.checkpoint.dir", None)
        if there is None:
            if sc.master != "local" and not sc.master.startswith("local["):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            there = tempfile.mkdtemp(prefix="cw-checkpoint-")
        sc.setCheckpointDir(there)
    return there


def _cut(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def owner_edges(claims: DataFrame) -> DataFrame:
    """owned, owner, share: one edge for each pair, with the largest filed share (null only if none is filed)."""
    return claims.groupBy("owned", "owner").agg(F.max("share").alias("share"))


def of_members(rows: DataFrame, members: DataFrame, *columns: str) -> DataFrame:
    """What holds of a group, as a row of each of its ``members`` (root, group); of ``columns``, the group's own name becomes the member's.

    Roots with equal edges to owners are one group, worked out once; no root of a group may own anything.
    """
    own = lambda c: F.when(F.col(c) == F.col("group"), F.col("__member")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
    both = rows.withColumnRenamed("root", "group").join(members.select(F.col("root").alias("__member"), "group"), "group")
    return both.select(*(F.col("__member").alias("root") if c == "root" else own(c) for c in rows.columns))


def effective_ownership(roots: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """root, owner, effective, routes, incomplete, terminal.

    Sums over acyclic paths of the product of shares, level by level: a level is
    one join of open paths with the edges.  A path through an edge without a
    share adds nothing and marks what it reaches as incomplete.
    """
    one = F.lit(1).cast(S.PRODUCT)
    level = roots.select(F.col("root"), F.col("root").alias("at"), one.alias("eff"), F.lit(False).alias("lossy"), F.array("root").alias("path"))
    found: DataFrame | None = None
    for _ in range(max_depth):
        step = level.join(edges, F.col("at") == F.col("owned")).filter(~F.array_contains("path", F.col("owner")))
        share = F.coalesce(F.col("share"), F.lit(0).cast(S.SHARE))
        level = step.select("root", F.col("owner").alias("at"), (F.col("eff") * share.cast("decimal(9,8)")).cast(S.PRODUCT).alias("eff"), (F.col("lossy") | F.col("share").isNull()).alias("lossy"), F.concat("path", F.array("owner")).alias("path"))
        here = level.select("root", F.col("at").alias("owner"), "eff", "lossy")
        found = here if found is None else found.unionByName(here)
    total = found.groupBy("root", "owner").agg(F.sum("eff").cast(S.PRODUCT).alias("effective"), F.count(F.lit(1)).alias("routes"), F.bool_or("lossy").alias("incomplete"))
    owned = edges.select(F.col("owned").alias("owner")).distinct().withColumn("__more", F.lit(True))
    return total.join(owned, "owner", "left").select("root", "owner", "effective", "routes", "incomplete", F.col("__more").isNull().alias("terminal"))


def expand(roots: DataFrame, edges: DataFrame, kinds: DataFrame, *, max_depth: int = 4, max_nodes: int | None = 200) -> DataFrame:
    """root, node, depth, stop: level-wise expansion with budgets.

    ``kinds`` (node, kind) has kind person, company or opaque; a company without
    an entry was not found.  A node stops as natural_person, unresolvable,
    max_depth, budget or not_found, in that order of tests; others are expanded.
    The budget holds exactly: nodes are ranked as discovered, by depth, parent
    and id.  None is no budget.
    """
    from pyspark.sql import Window

    known = _cut(roots.select("root", F.col("root").alias("node"), F.lit(0).alias("depth"), F.lit(None).cast("string").alias("stop"), F.lit(0).cast("long").alias("rank")))
    frontier = known
    for depth in range(1, max_depth + 1):
        step = frontier.filter("stop IS NULL").join(edges.select(F.col("owned").alias("node"), "owner"), "node")
        new = step.groupBy("root", F.col("owner").alias("next")).agg(F.min("node").alias("parent"))
        new = new.join(known.select("root", F.col("node").alias("next")), ["root", "next"], "left_anti")
        if max_nodes is None:
            ranked = new.withColumn("rank", F.lit(None).cast("long"))
        else:
            seen = known.groupBy("root").agg(F.count(F.lit(1)).alias("__seen"))
            order = Window.partitionBy("root").orderBy("parent", "next")
            ranked = new.join(seen, "root").withColumn("rank", F.row_number().over(order) - 1 + F.col("__seen"))
        typed = ranked.join(kinds.select(F.col("node").alias("next"), "kind"), "next", "left")
        stop = (
            F.when(F.col("kind") == "person", "natural_person")
            .when(F.col("kind") == "opaque", "unresolvable")
            .when(F.lit(depth) >= max_depth, "max_depth")
            .when(F.col("rank") >= F.lit(max_nodes), "budget")
            .when(F.col("kind").isNull(), "not_found")
        )
        frontier = _cut(typed.select("root", F.col("next").alias("node"), F.lit(depth).alias("depth"), stop.alias("stop"), F.col("rank").cast("long").alias("rank")))
        known = known.unionByName(frontier)
        if not frontier.filter("stop IS NULL").limit(1).count():
            break
    return known.select("root", "node", "depth", "stop")


def cycle_marks(chain: DataFrame, edges: DataFrame, max_depth: int = 4) -> DataFrame:
    """root, node: known nodes that an expansion meets again as an owner and that own themselves through others.

    An edge back to a known owner closes a cycle if the owner's own owners lead
    up to the edge's other end.  A node that owns itself directly is no cycle.
    """
    inner = chain.filter("stop IS NULL").select("root", F.col("node").alias("owned"), F.col("depth").alias("__d")).join(edges.select("owned", "owner"), "owned")
    inner = inner.join(chain.select("root", F.col("node").alias("owner"), F.col("depth").alias("__e")), ["root", "owner"]).filter("owner <> owned")
    inner = _cut(inner.distinct())
    up = inner.select("root", F.col("owned").alias("at"), F.col("owner").alias("next"))
    walk = inner.filter("__e <= __d").select("root", "owner", F.col("owned").alias("goal"), F.col("owner").alias("at"))
    found: DataFrame | None = None
    for _ in range(max_depth):
        step = walk.join(up, ["root", "at"])
        here = step.filter("next = goal").select("root", F.col("owner").alias("node"))
        found = here if found is None else found.unionByName(here)
        walk = _cut(step.filter("next <> goal").select("root", "owner", "goal", F.col("next").alias("at")).distinct())
    return found.distinct()


def with_cycles(chain: DataFrame, marks: DataFrame) -> DataFrame:
    """The chain with ``cycle`` as the stop of marked nodes."""
    m = marks.withColumn("__cycle", F.lit(True))
    return chain.join(m, ["root", "node"], "left").select("root", "node", "depth", F.when(F.col("__cycle"), "cycle").otherwise(F.col("stop")).alias("stop"))


def connected(edges: DataFrame) -> DataFrame:
    """(node, component): the least node each node is linked with, by min-label rounds until none moves."""
    both = _cut(edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select("b", "a")).distinct())
    labels = _cut(both.groupBy(F.col("src").alias("node")).agg(F.least(F.first("src"), F.min("dst")).alias("component")))
    while True:
        heard = both.join(labels.select(F.col("node").alias("dst"), "component"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("heard"))
        near = labels.join(heard, "node").withColumn("next", F.least("component", "heard"))
        up = labels.select(F.col("node").alias("next"), F.col("component").alias("up"))
        new = _cut(near.join(up, "next").select("node", F.least("next", "up").alias("to"), "component"))
        labels = new.select("node", F.col("to").alias("component"))
        if not new.filter("to <> component").limit(1).count():
            return labels


def positions(owns: DataFrame, roles: DataFrame) -> DataFrame:
    """Dated positions of each person, both kinds of claim in one list (person, entity, capacity, valid_from, valid_to)."""
    return owns.select("person", "entity", F.lit("owner").alias("capacity"), "valid_from", "valid_to").unionByName(roles.select("person", "entity", "capacity", "valid_from", "valid_to"))


def shared_labels(entities: DataFrame) -> DataFrame:
    """slug, n_sources: local names that at least two sources use."""
    slug = F.regexp_replace(F.regexp_replace(F.lower("label"), "[^a-z0-9]+", "-"), "^-|-$", "")
    rows = entities.select(slug.alias("slug"), "source").filter("slug <> ''")
    return rows.groupBy("slug").agg(F.count_distinct("source").alias("n_sources")).filter("n_sources >= 2")


def statement_graph(statements: DataFrame, reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, label) and edges (src, dst, kind) of checked statements; a node keeps its first label.

    ``statements``: (uid, source, claim, subject, object, predicate, defects),
    ``reports``: (uid, depth, verb, speaker), outermost at 0.  Statements whose
    report has defects say nothing here.
    """
    ok = statements.filter("defects = 0")
    r = reports.join(ok.select("uid"), "uid", "left_semi")
    last = r.groupBy("uid").agg(F.max("depth").alias("depth"))
    report = lambda depth: F.concat_ws(":", F.lit("report"), "uid", depth)
    claim = F.concat(F.lit("claim:"), F.col("uid").cast("string"))
    some = ok.filter("object IS NOT NULL")
    edges = [
        r.select(report(F.col("depth")).alias("src"), F.col("speaker").alias("dst"), F.lit("by").alias("kind")),
        r.filter("depth > 0").select(report(F.col("depth") - 1).alias("src"), report(F.col("depth")).alias("dst"), F.lit("content").alias("kind")),
        last.select(report(F.col("depth")).alias("src"), claim.alias("dst"), F.lit("content").alias("kind")),
        ok.select(claim.alias("src"), F.col("subject").alias("dst"), F.lit("subject").alias("kind")),
        some.select(claim.alias("src"), F.col("object").alias("dst"), F.lit("object").alias("kind")),
        some.filter("predicate IS NOT NULL").select(F.col("subject").alias("src"), F.col("object").alias("dst"), F.concat(F.lit("rel:"), "predicate").alias("kind")),
    ]
    label = lambda d, ident, kind, text: d.select(ident.alias("id"), F.lit(kind).alias("kind"), text.alias("label"), F.col("uid"))
    nodes = [
        label(ok, F.col("source"), "source", F.col("source")),
        label(r, report(F.col("depth")), "report", F.col("verb")),
        label(r, F.col("speaker"), "entity", F.col("speaker")),
        label(ok, claim, "claim", F.col("claim")),
        label(ok, F.col("subject"), "entity", F.col("subject")),
        label(some, F.col("object"), "entity", F.col("object")),
    ]
    every = nodes[0]
    for n in nodes[1:]:
        every = every.unionByName(n)
    joined = edges[0]
    for e in edges[1:]:
        joined = joined.unionByName(e)
    return every.groupBy("id").agg(F.min_by(F.struct("kind", "label"), F.struct("uid", "kind", "label")).alias("x")).select("id", "x.kind", "x.label"), joined


def _linked_up(items: DataFrame) -> DataFrame:
    """id, up: the parent, where it is an item; of rows that repeat an id the least parent counts."""
    own = items.groupBy("id").agg(F.min("parent").alias("parent"))
    there = own.select(F.col("id").alias("__known"))
    return own.join(there, F.col("parent") == F.col("__known"), "left").select("id", F.col("__known").alias("up"))


def lineage(items: DataFrame) -> DataFrame:
    """id, chain (own id first): parents until one is missing or comes round again.

    Every round joins each chain with the chain of its last parent, so a chain of any
    length is whole after as many rounds as its length has bits.  All chains together hold as
    many ids as they have members; ``lineage_ranks`` tells long ones in a row each.
    """
    state = _cut(_linked_up(items).select("id", F.array("id").alias("chain"), F.col("up").alias("at")))
    while state.filter("at IS NOT NULL").limit(1).count():
        other = state.select(F.col("id").alias("__i"), F.col("chain").alias("__c"), F.col("at").alias("__a"))
        both = state.join(other, F.col("at") == F.col("__i"), "left").withColumn("__all", F.when(F.col("__c").isNull(), F.col("chain")).otherwise(F.concat("chain", "__c")))
        # parents that come round again add nothing new behind the first that does
        own = F.array_distinct("__all")
        state = _cut(both.select("id", own.alias("chain"), F.when(F.size(own) == F.size("__all"), F.col("__a")).alias("at")))
    return state.select("id", "chain")


def lineage_ranks(items: DataFrame) -> DataFrame:
    """id, parent, top, rank: the end of each item's line of parents and how many steps lead there; both null where the line comes round again.

    The line of an item is told by rows: those with its ``top`` and smaller ranks that its parents lead to.  Distances
    double in every round.  Of lines that end, each round ends some, so what is left of a round without any comes round again.
    """
    linked = _cut(_linked_up(items))
    state = _cut(linked.select("id", F.col("up").alias("parent"), F.col("up").alias("jump"), F.when(F.col("up").isNull(), F.col("id")).alias("top"), F.col("up").isNotNull().cast("long").alias("rank")))
    left = state.filter("jump IS NOT NULL").count()
    while left:
        other = state.select(F.col("id").alias("__i"), F.col("jump").alias("__j"), F.col("top").alias("__t"), F.col("rank").alias("__r"))
        both = state.filter("jump IS NOT NULL").join(other, F.col("jump") == F.col("__i"))
        moved = both.select("id", "parent", F.col("__j").alias("jump"), F.col("__t").alias("top"), (F.col("rank") + F.col("__r")).alias("rank"))
        state = _cut(state.filter("jump IS NULL").unionByName(moved))
        before, left = left, state.filter("jump IS NOT NULL").count()
        if left == before:
            break
    return state.select("id", "parent", "top", F.when(F.col("top").isNotNull(), F.col("rank")).alias("rank"))


def foreign_expansions(entries: DataFrame, registers: DataFrame, resolved: DataFrame, home: str) -> DataFrame:
    """person, entity, country, register, because: entities outside the home country to look up, each once for a person.

    ``entries``: (person, entity, country, seq); a country without a register is
    told as a limit of coverage.
    """
    abroad = entries.filter((F.coalesce("country", F.lit("")) != "") & (F.col("country") != home)).join(resolved.select("entity").distinct(), "entity", "left_anti")
    first = abroad.groupBy("person", "entity").agg(F.min_by("country", "seq").alias("country"))
    known = first.join(F.broadcast(registers), "country", "left")  # a short table of registers
    because = F.when(F.col("register").isNotNull(), F.concat("country", F.lit("'s register is "), "register")).otherwise(F.concat(F.lit("no connected register covers "), "country"))
    return known.select("person", "entity", "country", "register", because.alias("because"))
