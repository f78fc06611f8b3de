import re

import numpy as np
from pyspark.sql import functions as F

from weftgraph.llm import op4_mixing as mixing


def level_targets(sizes: list[tuple[str | None, int]]) -> dict:
    """Water-filling step by step: reshare what is over until no source is."""
    order = sorted(sizes, key=lambda s: (s[0] is None, (s[0] or "").encode()))
    weight = {s: mixing.WEIGHTS[k % 3] for k, (s, _) in enumerate(order)}
    size = dict(order)
    total, full = 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        open_ = [s for s in size if s not in full]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if level * weight[s] > 2 * size[s]}
        if not over:
            return {s: 2.0 * size[s] if s in full else level * weight[s] for s in size}
        full |= over


def test_targets(spark):
    for sizes in ([("a", 100), ("b", 5), (None, 70), ("é", 1000), ("z", 0)], [("x", 9)], [("a", 10), ("b", 10), ("c", 10)], [(str(k), k * k) for k in range(20)]):
        df = spark.createDataFrame(sizes, "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = level_targets(sizes)
        assert got.keys() == want.keys()
        for s in want:
            assert abs(got[s] - want[s]) < 1e-6 * max(1, want[s])


def test_flight_keeps_sums():
    r = np.random.default_rng(4)
    x = np.stack([r.integers(0, 900, 500) / 900, np.ones(500)], axis=1)
    p = np.full(500, 0.37)
    out = mixing.flight(p, x, 1)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert np.allclose(x.T @ out, x.T @ p, atol=1e-6)
    assert (mixing.flight(p, x, 1) == out).all()
    assert ((mixing.flight(np.full(50, 0.5), np.ones((50, 2)), 2) % 1) > 0).sum() <= 1
    # each one's chance stays what it was
    mean = np.mean([mixing.landing(mixing.flight(np.full(12, 0.25), x[:12], s), x[:12, 0]) for s in range(800)], axis=0)
    assert abs(mean - 0.25).max() < 0.08


def test_mix(spark, docs_with_odd_rows):
    rows = mixing.mixed(docs_with_odd_rows).collect()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((r.doc_id, r.size) for r in rows) == sorted((r.doc_id, words(r.text)) for r in docs_with_odd_rows.collect())
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append(r)
    want = level_targets([(s, sum(r["size"] for r in v)) for s, v in by.items()])
    for s, v in by.items():
        assert abs(v[0].target - want[s]) < 1e-6 * max(1, want[s])
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(r["size"] for r in v)
    again = mixing.mixed(docs_with_odd_rows.repartition(3)).collect()
    assert sorted((r.doc_id, r.taken) for r in again) == sorted((r.doc_id, r.taken) for r in rows)
    taken = mixing.mix(docs_with_odd_rows)
    assert taken.columns == docs_with_odd_rows.columns
    assert taken.count() == sum(r.times for r in rows)
    assert mixing.mixed(docs_with_odd_rows.limit(0)).collect() == []


def test_blocks_meet(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 8)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 97).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    for r in mixing.mixed(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
        assert abs(r.taken - r.target) <= 97


def test_long_ids_beside_null_ones(spark):
    first = 2**53 + 1
    rows = [(first + i, "w " * (i % 7 + 1), f"s{i % 2}") for i in range(59)] + [(None, "no id", "s0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    made = mixing.mixed(docs).collect()
    assert {r.doc_id for r in made} == {r[0] for r in rows} and len(made) == len(rows)
    taken = mixing.mix(docs).collect()
    assert len(taken) == sum(r.times for r in made)
    assert all((r.doc_id, r.text, r.source) in set(rows) for r in taken)
