"""Graphs as edge tables (src, dst, weight) and triples (s, p, o).

Iterative operators keep one row a node or fact, write their state in each round (to
spark.checkpoint.dir, where it is set) and end when nothing changes.
"""

from __future__ import annotations

from collections.abc import Sequence
from contextlib import ExitStack

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.state import FEW, checkpointed, kept


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge and its reverse, from one reading of edges."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    ways = F.array(F.struct("src", "dst"), F.struct(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return edges.select(F.explode(ways).alias("e"), *rest).select("e.src", "e.dst", *rest)


def _sent(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _roots(up: DataFrame) -> tuple[DataFrame, int]:
    """up (node, parent) with each parent's last ancestor as parent, and its rows; parents are less than their nodes."""
    rows = up.count()
    while True:
        above = up.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
        new = checkpointed(up.join(_sent(above, rows), "parent", "left").select("node", F.coalesce("next", "parent").alias("parent"), F.col("next").isNotNull().alias("moved")))
        up = new.select("node", "parent")
        if not new.filter("moved").limit(1).count():
            return up, rows


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component: the least node that undirected edges connect it to.

    Each round joins every node to its least neighbour, if that is less than itself, follows
    such joins to their ends and goes on with the edges between different ends only, so
    that of the nodes with an edge at most half are left after two rounds.
    """
    # least and greatest pass over nulls: an edge with one end is a loop there
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).filter("a IS NOT NULL")
    labels = None
    with ExitStack() as held:
        pairs = held.enter_context(kept(pairs))
        nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        while True:
            up, rows = _roots(checkpointed(pairs.filter("a < b").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("parent"))))
            if not rows:
                return checkpointed(nodes.withColumn("component", F.col("node"))) if labels is None else labels
            start, column = (nodes, "node") if labels is None else (labels, "component")
            labels = checkpointed(start.join(_sent(up.select(F.col("node").alias("_n"), "parent"), rows), F.col(column) == F.col("_n"), "left").select("node", F.coalesce("parent", column).alias("component")))
            ends = _sent(up, rows)
            moved = pairs.filter("a < b").join(ends, F.col("b") == F.col("node")).select("a", F.col("parent").alias("c")).filter("a <> c").distinct()
            moved = moved.join(ends, F.col("a") == F.col("node"), "left").select(F.coalesce("parent", "a").alias("a"), "c").filter("a <> c")
            pairs = held.enter_context(kept(moved.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("b"))))


def bfs(edges: DataFrame, starts: Sequence | None, max_depth: int | None = None) -> DataFrame:
    """node, distance in edges from the nearest start (None: the least src); unreached nodes have no row."""
    spark, kind = edges.sparkSession, edges.schema["src"].dataType
    with kept(edges.select("src", "dst"), "src") as edges:
        if starts is None:
            starts = [edges.agg(F.min("src")).first()[0]]
        seen = checkpointed(spark.createDataFrame([(s,) for s in starts], "node string" if kind.simpleString() == "string" else f"node {kind.simpleString()}").distinct().withColumn("distance", F.lit(0)))
        frontier, rows, depth = seen, len(starts), 0
        while max_depth is None or depth < max_depth:
            depth += 1
            found = edges.join(_sent(frontier, rows), F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen, "node", "left_anti").withColumn("distance", F.lit(depth))
            frontier = checkpointed(found)
            rows = frontier.count()
            if not rows:
                break
            seen = checkpointed(seen.unionByName(frontier))
        return seen


def shortest_paths(edges: DataFrame, start=None) -> DataFrame:
    """node, distance by weight from start (None: the least src): rounds of relaxed edges, of the nodes that got nearer only.

    The edges are made once and stay where they are; a round moves the nearer nodes and an
    offer a node and task. An edge without a weight leads nowhere.
    """
    spark, kind = edges.sparkSession, edges.schema["src"].dataType.simpleString()
    with kept(edges.select("src", "dst", "weight"), "src") as edges:
        if edges.filter("weight < 0").limit(1).count():
            raise ValueError("weights must not be negative")
        if start is None:
            start = edges.agg(F.min("src")).first()[0]
        known = checkpointed(spark.createDataFrame([(start, 0.0, True)], f"node {kind}, distance double, nearer boolean"))
        rows = 1
        while rows:
            frontier = known.filter("nearer").select(F.col("node").alias("src"), "distance")
            offers = edges.join(_sent(frontier, rows), "src").groupBy(F.col("dst").alias("node")).agg(F.min(F.col("distance") + F.col("weight")).alias("offer")).filter("node IS NOT NULL AND offer IS NOT NULL")
            known = checkpointed(known.select("node", "distance").join(offers, "node", "full").select("node", F.least("distance", "offer").alias("distance"), F.coalesce(F.col("distance").isNull() | (F.col("offer") < F.col("distance")), F.lit(False)).alias("nearer")))
            rows = known.filter("nearer").count()
        return known.select("node", "distance")


def topological_levels(edges: DataFrame) -> DataFrame:
    """node, level: the longest path into a node; a cycle is an error."""
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    left, rest, level, out = checkpointed(edges.select("src", "dst").distinct()), checkpointed(nodes), 0, None
    while rest.limit(1).count():
        free = checkpointed(rest.join(left.select(F.col("dst").alias("node")).distinct(), "node", "left_anti").withColumn("level", F.lit(level)))
        if not free.limit(1).count():
            raise ValueError("the graph has a cycle")
        out = free if out is None else out.unionByName(free)
        rest = checkpointed(rest.join(free, "node", "left_anti"))
        left = checkpointed(left.join(free.select(F.col("node").alias("src")), "src", "left_anti"))
        level += 1
    return out if out is not None else nodes.withColumn("level", F.lit(0))


def degrees(edges: DataFrame) -> DataFrame:
    """node, out_degree, in_degree."""
    sides = edges.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("s")).select("s.*")
    return sides.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))


def subgraph_matches(edges: DataFrame, pattern: list[tuple[str, str]]) -> DataFrame:
    """A column for each pattern node: all injective images of the pattern's edges, by equi-joins."""
    e, found = edges.select("src", "dst").distinct(), None
    for a, b in pattern:
        nxt = e.select(F.col("src").alias(a), F.col("dst").alias(b)).filter(F.col(a) != F.col(b))
        if found is None:
            found = nxt
            continue
        shared = [c for c in (a, b) if c in found.columns]
        if not shared:
            raise ValueError("list a connected pattern's edges so that each shares a node with those before")
        new, old = [c for c in (a, b) if c not in found.columns], found.columns
        found = found.join(nxt, shared)
        for c in new:
            for o in old:
                found = found.filter(F.col(c) != F.col(o))
    return found


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of the ?variables of all patterns: one equi-join for each further pattern."""
    found = None
    for pattern in patterns:
        rows, taken = triples, {}
        for column, term in zip(("s", "p", "o"), pattern):
            if not term.startswith("?"):
                rows = rows.filter(F.col(column) == term)
            elif term in taken:
                rows = rows.filter(F.col(column) == F.col(taken[term]))
            else:
                taken[term] = column
        rows = rows.select(*(F.col(c).alias(t[1:]) for t, c in taken.items())).distinct()
        if found is None:
            found = rows
        else:
            shared = [c for c in rows.columns if c in found.columns]
            if not shared:
                raise ValueError("a pattern must share a variable with those before it")
            found = found.join(rows, shared)
    return found


def infer(triples: DataFrame, rules: list[tuple[list[tuple[str, str, str]], tuple[str, str, str]]], max_rounds: int = 100) -> DataFrame:
    """s, p, o, derived: the facts and all that follow by the rules (premises, conclusion), to the fixpoint."""
    facts = checkpointed(triples.select("s", "p", "o").distinct().withColumn("derived", F.lit(False)))
    for _ in range(max_rounds):
        new = None
        for premises, conclusion in rules:
            b = match(facts, premises)
            one = b.select(*((F.col(t[1:]) if t.startswith("?") else F.lit(t)).alias(c) for c, t in zip(("s", "p", "o"), conclusion)))
            new = one if new is None else new.unionByName(one)
        if new is None:
            break
        fresh = checkpointed(new.distinct().join(facts, ["s", "p", "o"], "left_anti").withColumn("derived", F.lit(True)))
        if not fresh.limit(1).count():
            break
        facts = checkpointed(facts.unionByName(fresh))
    return facts


def strongly_connected_components(edges: DataFrame, max_rounds: int = 10_000) -> DataFrame:
    """node, component: the greatest node that each node reaches and that reaches it.

    By colours: every node takes the greatest node that reaches it forwards; from that
    root, nodes of its colour that reach it backwards are its component and leave. Rounds
    go on over what is left, each written, until nothing is.
    """
    left = checkpointed(edges.select("src", "dst").filter("src <> dst").distinct())
    nodes = checkpointed(edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct())
    done = None
    for _ in range(max_rounds):
        colours = checkpointed(nodes.withColumn("colour", F.col("node")))
        while True:
            came = left.join(colours, F.col("src") == F.col("node")).groupBy("dst").agg(F.max("colour").alias("c"))
            new = checkpointed(colours.join(came, F.col("node") == F.col("dst"), "left").select("node", F.greatest("colour", F.coalesce("c", "colour")).alias("colour")))
            changed = new.join(colours.withColumnRenamed("colour", "old"), "node").filter("colour <> old").limit(1).count()
            colours = new
            if not changed:
                break
        # edges within a colour, walked backwards from its root
        a, b = colours.select(F.col("node").alias("src"), F.col("colour").alias("cs")), colours.select(F.col("node").alias("dst"), F.col("colour").alias("cd"))
        inner = checkpointed(left.join(a, "src").join(b, "dst").filter("cs = cd").select("src", "dst"))
        found = checkpointed(colours.filter("node = colour").select("node", F.col("colour").alias("component")))
        edge = found
        while True:
            back = inner.join(edge, F.col("dst") == F.col("node")).select(F.col("src").alias("node"), "component").distinct()
            edge = checkpointed(back.join(found, "node", "left_anti"))
            if not edge.limit(1).count():
                break
            found = checkpointed(found.unionByName(edge))
        done = found if done is None else checkpointed(done.unionByName(found))
        nodes = checkpointed(nodes.join(found, "node", "left_anti"))
        if not nodes.limit(1).count():
            return done
        left = checkpointed(left.join(nodes, F.col("src") == F.col("node"), "left_semi").join(nodes, F.col("dst") == F.col("node"), "left_semi"))
    raise ValueError("too many rounds")


def schedule(tasks: DataFrame, edges: DataFrame, id_col: str = "task", duration: str = "duration") -> DataFrame:
    """task, start, end: the earliest times of a schedule in which src ends before dst
    starts. Rounds relax starts until nothing changes; a cycle is an error after as many rounds as tasks."""
    times = checkpointed(tasks.select(F.col(id_col).alias("task"), F.col(duration).cast("double").alias("d"), F.lit(0.0).alias("start")))
    for _ in range(tasks.count() + 1):
        came = edges.join(times, F.col("src") == F.col("task")).groupBy("dst").agg(F.max(F.col("start") + F.col("d")).alias("s"))
        new = checkpointed(times.join(came, F.col("task") == F.col("dst"), "left").select("task", "d", F.greatest("start", F.coalesce("s", F.lit(0.0))).alias("start")))
        changed = new.join(times.select("task", F.col("start").alias("old")), "task").filter("start <> old").limit(1).count()
        times = new
        if not changed:
            return times.select("task", "start", (F.col("start") + F.col("d")).alias("end"))
    raise ValueError("a cycle")


def to_dot(edges: DataFrame) -> DataFrame:
    """line: an edge a line in the DOT language, to be written as text."""
    name = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(name("src"), F.lit(" -> "), name("dst"), F.lit(";")).alias("line"))
