"""Positions of modules and definitions, by window arithmetic or by forces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import settled
from weftgraph.operators.indexes import indexed

# Sizes of pods and grids.
POD_W, POD_H, GAP_X, GAP_Y = 200, 52, 30, 80
TILE, CELL = 1000, 40


def pod_layout(ranked: DataFrame) -> DataFrame:
    """ranked (node, rank) -> node, x, y, w, h: one row of pods per rank that occurs, centred on x = 0."""
    row = W.partitionBy("rank")
    per_rank = ranked.select("rank").distinct().withColumn("level", F.row_number().over(W.orderBy("rank")) - 1)  # as many rows as ranks
    placed = ranked.withColumn("i", F.row_number().over(row.orderBy("node")) - 1).withColumn("k", F.count("*").over(row)).join(per_rank, "rank")
    width = F.col("k") * POD_W + (F.col("k") - 1) * GAP_X
    x = -width / 2 + F.col("i") * (POD_W + GAP_X)
    return placed.select("node", x.cast("double").alias("x"), (F.col("level") * (POD_H + GAP_Y)).cast("double").alias("y"), F.lit(float(POD_W)).alias("w"), F.lit(float(POD_H)).alias("h"))


def grid_layout(nodes: DataFrame) -> DataFrame:
    """nodes (key, module, ord) -> key, x, y: modules as tiles in order of first appearance, members within, last first."""
    first = nodes.groupBy("module").agg(F.min("ord").alias("first"), F.count("*").alias("k"))
    n = first.agg(F.count("*").alias("n"))  # one row
    tiles = indexed(first, ["first", "module"], "t").crossJoin(F.broadcast(n)).withColumn("cols", F.ceil(F.sqrt("n")))
    tiles = tiles.select("module", "k", (F.col("t") % F.col("cols") * TILE).alias("tx"), (F.floor(F.col("t") / F.col("cols")) * TILE).alias("ty"))
    own = nodes.withColumn("i", F.row_number().over(W.partitionBy("module").orderBy(F.desc("ord"), "key")) - 1).join(tiles, "module")
    side = F.ceil(F.sqrt("k"))
    half = (side - 1) * CELL / 2
    x = F.col("tx") + F.col("i") % side * CELL - half
    y = F.col("ty") + F.floor(F.col("i") / side) * CELL - half
    return own.select("key", x.cast("double").alias("x"), y.cast("double").alias("y"))


def force_layout(nodes: DataFrame, edges: DataFrame, rounds: int = 12, side: int = 16, length: float = 40.0) -> DataFrame:
    """(key, x, y) of nodes (key, x, y) moved by forces for some rounds: edges (src, dst) draw their ends together, all nodes push each other apart.

    What pushes a node are the cells of a grid of side times side over all nodes, each as one body with as many nodes as
    it has where these are on average; so a round is a join with the edges and a sum over a table of fixed size, which
    every task gets. Steps become shorter from round to round. A node without edges is only pushed. Coinciding nodes are
    told apart by a hash of their keys. Nodes without a place and edges of unknown nodes are left out.
    """
    e = settled(edges.where("src != dst").select("src", "dst").distinct())
    both = settled(e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    jitter = lambda k: (F.pmod(F.xxhash64("key", F.lit(k)), F.lit(1009)) / 1009 - 0.5) * length / 8
    at = settled(nodes.where("x is not null and y is not null").select("key", (F.col("x") + jitter(1)).alias("x"), (F.col("y") + jitter(2)).alias("y")))
    for k in range(rounds):
        # one row: the extent, and below at most side * side bodies
        extent = at.agg(F.min("x").alias("x0"), F.min("y").alias("y0"), (F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)) / side).alias("w"))
        cell = lambda c, low: F.least(F.floor((F.col(c) - F.col(low)) / F.col("w")), F.lit(side - 1)).cast("int")
        celled = settled(at.crossJoin(F.broadcast(extent)).select("key", "x", "y", "w", cell("x", "x0").alias("cx"), cell("y", "y0").alias("cy")))
        bodies = celled.groupBy("cx", "cy").agg(F.count("*").cast("double").alias("n"), F.avg("x").alias("bx"), F.avg("y").alias("by"))
        field = bodies.agg(F.array_sort(F.collect_list(F.struct("cx", "cy", "n", "bx", "by"))).alias("bodies"))
        push = lambda c, b: F.aggregate("bodies", F.lit(0.0), lambda a, o: a + (F.col(c) - o[b]) * o["n"] * length * length / ((F.col("x") - o["bx"]) * (F.col("x") - o["bx"]) + (F.col("y") - o["by"]) * (F.col("y") - o["by"]) + length * length))
        pushed = celled.crossJoin(F.broadcast(field)).select("key", "x", "y", "w", push("x", "bx").alias("px"), push("y", "by").alias("py"))
        ends = at.select(F.col("key").alias("dst"), F.col("x").alias("tx"), F.col("y").alias("ty"))
        starts = at.select(F.col("key").alias("src"), F.col("x").alias("sx"), F.col("y").alias("sy"))
        lines = both.join(starts, "src").join(ends, "dst").withColumn("d", F.hypot(F.col("tx") - F.col("sx"), F.col("ty") - F.col("sy")))
        drawn = lines.groupBy(F.col("src").alias("key")).agg(F.sum((F.col("tx") - F.col("sx")) * F.col("d") / length).alias("dx"), F.sum((F.col("ty") - F.col("sy")) * F.col("d") / length).alias("dy"))
        force = pushed.join(drawn, "key", "left").select("key", "x", "y", (F.col("px") + F.coalesce("dx", F.lit(0.0))).alias("fx"), (F.col("py") + F.coalesce("dy", F.lit(0.0))).alias("fy"))
        step = length * 2 * (1 - k / rounds)
        size = F.greatest(F.hypot("fx", "fy"), F.lit(1e-9))
        at = settled(force.select("key", (F.col("x") + F.col("fx") / size * F.least(size, F.lit(step))).alias("x"), (F.col("y") + F.col("fy") / size * F.least(size, F.lit(step))).alias("y")))
    return at
