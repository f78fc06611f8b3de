"""Components and implied edges of random graphs, postings, growing lists and compared documents, against plain versions."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import fixpoint, incremental, indexes
from weftgraph.sinks import golden


def reached(edges):
    out = set(edges)
    while True:
        more = {(a, d) for a, b in out for c, d in edges if b == c} - out
        if not more:
            return out
        out |= more


@pytest.mark.parametrize("seed, nodes, n", [(1, 8, 14), (2, 14, 18), (3, 6, 0), (4, 10, 40)])
def test_random_graphs(spark, seed, nodes, n):
    r = random.Random(seed)
    name = lambda k: f"n{k:02}"
    edges = {(name(r.randrange(nodes)), name(r.randrange(nodes))) for _ in range(n)}
    df = spark.createDataFrame(sorted(edges) + sorted(edges)[:3], "src string, dst string")
    to = reached(edges)
    circle = {a: min([b for b in map(name, range(nodes)) if (a, b) in to and (b, a) in to] + [a]) for a in map(name, range(nodes)) if any(a != b and (a, b) in to and (b, a) in to for b in map(name, range(nodes)))}
    assert {x.node: x.component for x in fixpoint.strong_components(df).collect()} == circle
    implied = {(a, b) for a, b in edges if any(c != b and (c, b) in to for x, c in edges if x == a)}
    assert sorted(map(tuple, fixpoint.transitive_edges(df).collect())) == sorted(implied)


def test_postings(spark):
    modules = [(0, "Ab.c"), (1, "x")]
    definitions = [(k, f"Ab.n{k}") for k in range(300)] + [(300, "zAb"), (301, "")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, name string")
    blocks = indexes.posting_blocks(frame(modules), frame(definitions), block=64)
    every = {i: n.lower() for i, n in modules} | {i + 2: n.lower() for i, n in definitions}
    got = {}
    for row in blocks.collect():
        ids = [row.first]
        for d in row.deltas:
            ids.append(ids[-1] + d)
        assert len(ids) == row.n and all(i // 64 == row.block for i in ids)
        got.setdefault(row.bigram, []).extend(ids)
    grams = {n[k : k + 2] for n in every.values() for k in range(len(n) - 1)}
    assert {g: sorted(v) for g, v in got.items()} == {g: sorted(i for i, n in every.items() if g in n) for g in grams}
    asked = spark.createDataFrame([("AB",), ("n12",), ("zab",), ("nothing",)], "text string")
    found = {}
    for row in indexes.found_names(blocks, asked).collect():
        found.setdefault(row.text, set()).add(row.id)
    has = lambda n, t: all(t[k : k + 2] in n for k in range(len(t) - 1))
    assert found == {t: ids for t in ("AB", "n12", "zab") if (ids := {i for i, n in every.items() if has(n, t.lower())})}
    assert indexes.posting_blocks(frame(modules), frame(definitions), most=10).collect() == []
    assert indexes.posting_blocks(frame([]), frame(modules)).count() > 0


def test_growing_lists(spark):
    lists = {"a": "xyxx", "b": "q", "new": "mm", "again": "z", "same": "kk"}
    rows = [(k, i, v) for k, vs in lists.items() for i, v in enumerate(vs)]
    marks = [("a", 2), ("b", 0), ("again", 3), ("same", 2), ("gone", 4)]
    new, after = incremental.list_ends(spark.createDataFrame(rows, "key string, pos int, value string"), spark.createDataFrame(marks, "key string, length long"))
    assert sorted((r.key, r.pos, r.value) for r in new.collect()) == [("a", 2, "x"), ("a", 3, "x"), ("again", 0, "z"), ("b", 0, "q"), ("new", 0, "m"), ("new", 1, "m")]
    assert {r.key: r.length for r in after.collect()} == {"a": 4, "b": 1, "new": 2, "again": 1, "same": 2, "gone": 4}


def test_compared_documents(spark):
    old = {"v": 1, "list": [1, {"a/b": "é"}], "gone": [], "producer": {"x": 1}}
    new = {"v": 1, "list": [1, {"a/b": "e"}, None], "more": {"k": True}, "producer": {"x": 2}}
    frame = lambda d, t: spark.createDataFrame([("doc", json.dumps(d)), ("text", t)], "name string, value string")
    got = {(r.name, r.path): (r.golden, r.now) for r in golden.differences(frame(new, "{"), frame(old, "[]"), ("/producer",)).collect()}
    assert got == {("doc", "/list/1/a~1b"): ('"é"', '"e"'), ("doc", "/list/2"): (None, "null"), ("doc", "/gone"): ("[]", None), ("doc", "/more/k"): (None, "true"), ("text", ""): ("[]", None), ("text", "(no JSON)"): (None, "{")}
    assert golden.differences(frame(old, "1"), frame(old, "1")).where(F.lit(True)).collect() == []
