"""Iteration to a fixpoint over DataFrames.

A round's new rows are written to the shared checkpoint folder, which cuts the lineage and outlives
executors; old rows are kept apart, so a round reads only what is new on one side of its join.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Spark's setting by which a query's shuffle files go when it ends.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def settled(df: DataFrame) -> DataFrame:
    """df computed once, in the folder of spark.checkpoint.dir; only a session on one machine may name none and gets one.

    What was shuffled for it goes at once, and not when the driver happens to collect its garbage.
    """
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or "file://" + os.path.join(tempfile.gettempdir(), "weftgraph-checkpoints"))
    conf = df.sparkSession.conf
    before = conf.get(SHUFFLES_GO, "false")
    conf.set(SHUFFLES_GO, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # a plan takes the setting over when it is made
    finally:
        conf.set(SHUFFLES_GO, before)


def union_all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def grow(seed: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """Rows of seed and all that step makes of new rows, until it makes none; a key's first row stays.

    Terminates on cycles, as rows whose key is known are dropped; rounds bounds the depth.
    """
    return _grown(settled(seed.dropDuplicates(keys)), step, keys, rounds)


def _grown(new: DataFrame, step: Callable[[DataFrame], DataFrame], keys: list[str], rounds: int | None = None) -> DataFrame:
    """grow from rows new that are settled already, one a key."""
    found, n = [new], 0
    while (rounds is None or n < rounds) and not new.isEmpty():
        n += 1
        new = settled(step(new).dropDuplicates(keys).join(union_all(found).select(*keys), keys, "left_anti"))
        found.append(new)
    return union_all(found)


def closure(edges: DataFrame, seeds: DataFrame | None = None, rounds: int | None = None) -> DataFrame:
    """(src, dst) for every dst that edges lead to from src in one step or more; from seeds (src) only, if given."""
    e = settled(edges.select("src", "dst").distinct())
    start = e if seeds is None else settled(e.join(seeds.select("src").distinct(), "src", "left_semi"))
    hop = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    return _grown(start, lambda new: new.join(hop, "dst").select("src", F.col("next").alias("dst")), ["src", "dst"], rounds)


def bfs_depth(edges: DataFrame, nodes: DataFrame, start: DataFrame) -> DataFrame:
    """(node, depth): steps from the nearest start; -1 for nodes out of reach or if there is no start."""
    e = settled(edges.select("src", "dst").distinct())
    hop = e.select(F.col("src").alias("node"), F.col("dst").alias("next"))
    first = start.select("node", F.lit(0).alias("depth"))
    reached = grow(first, lambda new: new.join(hop, "node").select(F.col("next").alias("node"), (F.col("depth") + 1).alias("depth")), ["node"])
    return nodes.select("node").distinct().join(reached, "node", "left").select("node", F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def longest_ranks(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, rank): the longest path that leads to a node, by peeling nodes without open predecessors.

    Nodes in or below cycles are never peeled: they keep 1 + the largest rank of the predecessors that
    were, and 0 if none was. Edges from a node to itself keep that node from being peeled.
    """
    rest_e = settled(edges.select("src", "dst").distinct())
    rest_n = settled(nodes.select("node", F.lit(0).alias("rank")).unionByName(rest_e.select(F.col("dst").alias("node"), F.lit(0).alias("rank"))).unionByName(rest_e.select(F.col("src").alias("node"), F.lit(0).alias("rank"))).distinct())
    done = []
    while True:
        peeled = settled(rest_n.join(rest_e.select(F.col("dst").alias("node")), "node", "left_anti"))
        if peeled.isEmpty():
            return union_all([*done, rest_n]).select("node", F.col("rank").cast("int").alias("rank"))
        done.append(peeled)
        pushed = rest_e.join(peeled.select(F.col("node").alias("src"), (F.col("rank") + 1).alias("r")), "src").groupBy(F.col("dst").alias("node")).agg(F.max("r").alias("r"))
        rest_n = settled(rest_n.join(peeled.select("node"), "node", "left_anti").join(pushed, "node", "left").select("node", F.greatest("rank", F.coalesce("r", F.lit(0))).alias("rank")))
        rest_e = settled(rest_e.join(peeled.select(F.col("node").alias("src")), "src", "left_anti"))


def _core(edges: DataFrame) -> DataFrame:
    """Distinct edges without those that end where nothing goes on or begin where nothing leads to, again and again: what is left has all circles, and is empty if there is none."""
    core, before = edges, None
    while True:
        core = core.join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst")
        core = settled(core.distinct() if before is None else core)
        n = core.count()
        if n in (0, before):
            return core
        before = n


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on circles of edges (src, dst): the least node that it leads to and that leads to it. Other nodes are components of their own and give no row.

    What lies on no circle is peeled off. Then the least node goes forward as far as edges lead, as a colour, and back within
    its colour; that is the component of each node that kept its own name. The rest is done again without these.
    """
    core, found = _core(edges.where("src != dst").select("src", "dst")), []
    while not core.isEmpty():
        colour = settled(core.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("c", F.col("node")))
        moved = colour
        while not moved.isEmpty():
            sent = core.join(moved.select(F.col("node").alias("src"), "c"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("c").alias("least"))
            met = settled(colour.join(sent, "node", "left").select("node", F.least("c", "least").alias("c"), (F.col("least") < F.col("c")).alias("moved")))
            colour, moved = met.select("node", "c"), met.where("moved").select("node", "c")
        at = lambda end: colour.select(F.col("node").alias(end), F.col("c").alias(f"c_{end}"))
        back = settled(core.join(at("src"), "src").join(at("dst"), "dst").where("c_src = c_dst").select(F.col("dst").alias("node"), F.col("src").alias("before")))
        start = colour.where("node = c").select("node", F.col("c").alias("component"))
        own = settled(grow(start, lambda new, back=back: new.join(back, "node").select(F.col("before").alias("node"), "component"), ["node"]))
        found.append(own)
        gone = own.select("node")
        left = core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst")
        core = _core(settled(left))
    if not found:
        return edges.limit(0).select(F.col("src").alias("node"), F.col("dst").alias("component"))
    every = union_all(found)
    # a node that only kept its name because its circle was peeled apart is no component of several
    several = every.groupBy("component").count().where("count > 1").select("component")
    return every.join(several, "component", "left_semi").select("node", "component")


def transitive_edges(edges: DataFrame, most_nodes: int | None = None) -> DataFrame:
    """Edges (src, dst) that another successor of src also leads to, even if only by way of src.

    With most_nodes, none are computed for graphs of more nodes (an empty result then means that). Within a component, and
    to others from a node with a successor in its own, counts of successors decide. For the rest each node's search goes
    out from all its successors at once, over components, which have no circles; where it comes to one of them, it did so
    from another. So no pairs of successors are made, and a hub's search is spread by the nodes it has come to.
    """
    e = settled(edges.select("src", "dst").distinct())
    if most_nodes is not None and e.select(F.explode(F.array("src", "dst"))).distinct().limit(most_nodes + 1).count() > most_nodes:
        return e.limit(0)
    parts = settled(strong_components(e))
    circles = not parts.isEmpty()
    if circles:
        at = lambda end, name: parts.select(F.col("node").alias(end), F.col("component").alias(name))
        own = e.join(at("src", "a"), "src", "left").join(at("dst", "b"), "dst", "left")
        own = settled(own.select("src", "dst", F.coalesce("a", "src").alias("a"), F.coalesce("b", "dst").alias("b"), F.col("b").isNotNull().alias("round")))
    else:
        own = e.select("src", "dst", F.col("src").alias("a"), F.col("dst").alias("b"))
    beyond = own.where("a != b")
    goals = beyond.select("src", "b")
    more_than_one = F.min("b") != F.max("b") if circles else F.count("*") > 1
    several = goals.groupBy("src").agg(more_than_one.alias("more")).where("more").select("src")
    # only steps from what some edge leads to are ever taken
    hops = settled(beyond.join(beyond.select(F.col("b").alias("a")).distinct(), "a", "left_semi").select(F.col("a").alias("b"), F.col("b").alias("next")).distinct())
    new, found, hits = goals.join(several, "src", "left_semi"), [goals], []
    while True:
        gone = settled(new.join(hops, "b").select("src", F.col("next").alias("b")).distinct())
        if gone.isEmpty():
            break
        hits.append(settled(gone.join(goals, ["src", "b"], "left_semi")))
        new = settled(gone.join(union_all(found), ["src", "b"], "left_anti"))
        if new.isEmpty():
            break
        found.append(new)
    if not circles:
        return own.join(union_all(hits), ["src", "b"], "left_semi").select("src", "dst") if hits else e.limit(0)
    inside = settled(own.where("a = b").groupBy("src").agg(F.count("*").alias("n_own")))
    same = beyond.where("round").groupBy("src", "b").agg(F.count("*").alias("n_same")).where("n_same > 1").select("src", "b")
    way = settled(union_all([same, *hits]).distinct())
    within = own.where("a = b").join(inside.where("n_own > 1"), "src", "left_semi")
    back = beyond.join(inside, "src", "left_semi")
    return union_all([x.select("src", "dst") for x in (within, back, beyond.join(inside, "src", "left_anti").join(way, ["src", "b"], "left_semi"))])
