"""The force layout against one that sums over all pairs of nodes."""

import math
import random

import numpy as np

from weftgraph.catalogue import ORACLE_SQL, QUERIES
from weftgraph.operators import layout

LENGTH = 40.0


def energy(at: dict, edges: set) -> float:
    keys = sorted(at)
    x = np.array([at[k] for k in keys])
    apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    pushed = -LENGTH**2 / 2 * np.log(apart + LENGTH**2)[np.triu_indices(len(x), 1)].sum()
    return float(pushed + sum(math.dist(at[a], at[b]) ** 3 / (3 * LENGTH) for a, b in edges))


def all_pairs(at: dict, edges: set, rounds: int) -> dict:
    for k in range(rounds):
        keys = sorted(at)
        x = np.array([at[i] for i in keys])
        gap = x[:, None] - x[None]
        force = (gap * LENGTH**2 / ((gap**2).sum(axis=2) + LENGTH**2)[..., None]).sum(axis=1)
        for a, b in edges:
            i, j = keys.index(a), keys.index(b)
            pull = (x[j] - x[i]) * math.dist(x[i], x[j]) / LENGTH
            force[i] += pull
            force[j] -= pull
        size = np.maximum(np.hypot(*force.T), 1e-9)
        x = x + force / size[:, None] * np.minimum(size, LENGTH * 2 * (1 - k / rounds))[:, None]
        at = dict(zip(keys, map(tuple, x)))
    return at


def test_energy_is_near_that_of_all_pairs(spark):
    r = random.Random(6)
    start = {f"n{k:02}": (r.uniform(0, 900), r.uniform(0, 900)) for k in range(60)}
    edges = {(f"n{k:02}", f"n{(k + d) % 10 + k // 10 * 10:02}") for k in range(60) for d in (1, 3)}
    nodes = spark.createDataFrame([(k, *v) for k, v in start.items()] + [("lost", None, 1.0)], "key string, x double, y double")
    lines = spark.createDataFrame([*edges, ("n00", "n00"), ("n01", "nowhere")], "src string, dst string")
    got = {p.key: (p.x, p.y) for p in layout.force_layout(nodes, lines, rounds=8).collect()}
    assert set(got) == set(start)
    before, exact, made = energy(start, edges), energy(all_pairs(start, edges, 8), edges), energy(got, edges)
    assert exact < before and made < exact + 0.1 * (before - exact)
    again = {p.key: (p.x, p.y) for p in layout.force_layout(nodes.repartition(3), lines, rounds=8).collect()}
    assert all(math.dist(got[k], again[k]) < 1e-3 for k in got)


def test_few_nodes(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("b", 0.0, 0.0)], "key string, x double, y double")
    none = spark.createDataFrame([], "src string, dst string")
    at = {p.key: (p.x, p.y) for p in layout.force_layout(nodes, none, rounds=3).collect()}
    assert math.dist(at["a"], at["b"]) > 5
    assert layout.force_layout(nodes.limit(0), none, rounds=2).collect() == []


def test_query(spark):
    assert "force_layout" not in ORACLE_SQL
    rows = QUERIES["force_layout"](spark, "/root/testdata/sf0.001").collect()
    assert len({r.module for r in rows}) == len(rows) > 100 and all(math.isfinite(r.x + r.y) for r in rows)
