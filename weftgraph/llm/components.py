"""Connected components of a table of links, by alternating large and small stars; nothing is collected.

Once no more than AT_ONCE edges (16 MB) are left, one task finishes them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, mapped, stored

AT_ONCE = 1 << 20


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from every other node of a component to its smallest."""
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = ends[: len(u)], ends[len(u) :], np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
        a, b = root[a], root[b]
        a, b = a[a != b], b[a != b]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _finish(batches):
    ends = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if ends:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in stars(*map(np.concatenate, zip(*ends)))], names=["u", "v"])


def components(links: DataFrame) -> DataFrame:
    """links (a, b), longs -> (node, component): the smallest node that links lead to, for every node in links.

    Earlier components (a node and its component, each) and new links give the components of both.
    """
    nodes = links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(nodes, "stars")
    while True:
        if edges.count() <= AT_ONCE:
            last, edges = edges, stored(mapped(edges.coalesce(1), _finish, "u long, v long"), "stars")
            discard(last)
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # done once each node with a smaller neighbour has no other
        if both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).where("m < u and n > 1").isEmpty():
            break
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        met = large.join(least, "u")
        small = met.select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).where("u != v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        last, edges = edges, stored(small, "stars")
        discard(last)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
