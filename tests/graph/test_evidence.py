import pytest
from pyspark.sql import functions as F

from weftgraph.functions import text
from weftgraph.operators import argusage, evidence, filters, representations
from weftgraph.sinks import documents


def test_escapes():
    assert documents.embeddable('{"a":"</script>&\'"}') == '{"a":"\\u003c/script\\u003e\\u0026\\u0027"}'


def test_long_comments(spark):
    long = "a - b { c } " * 5000 + "{- x {- y -} z -}" + "tail-}"
    df = spark.createDataFrame([(long,)], "t string")
    assert df.select(text.without_block_comments(F.col("t")).alias("o")).first().o == "a - b { c } " * 5000 + "tail-}"


def test_capture_and_views(spark):
    df = spark.createDataFrame
    e = df([("r", "a"), ("r", "b"), ("a", "c"), ("c", "d"), ("r", "r")], "src string, dst string")
    got = {(r.src, r.dst): (r.d, r.status) for r in evidence.captured(e, most=3).collect()}
    assert got["r", "a"] == (1, "captured") and got["r", "c"] == (2, "capped") and ("r", "d") not in got
    declared = df([("D", "data", 1, 0, "nonrecursive", False), ("I", "data", 0, 1, "direct", True)], "key string, kind string, parameters int, indices int, recursion string, closed boolean")
    members = df([("D", "mk", "constructor"), ("I", "i", "constructor"), ("I", "f", "field")], "owner string, key string, role string")
    kept = df([("mk", 1), ("i", 5)], "key string, parameters int")
    inventory = representations.inventories(declared, members, kept)
    assert {r.key: (r.complete, list(r.limitations)) for r in inventory.collect()} == {"D": (True, []), "I": (False, ["abstract-or-opaque", "missing-member-signatures"])}
    views = representations.constructor_views(inventory, df([("mk", "D", True)], "name string, result_owner string, supported boolean"))
    assert {r.name: r.status for r in views.collect()} == {"mk": "complete", "i": "unavailable"}


def test_shift_keeps_fields_together(spark):
    u = spark.createDataFrame([("a", 4, 3, [2, 3], [], [(2, 3)], [2], [3]), ("b", 2, 2, [0], [], [], [], [])], "key string, arity int, syntactic_arity int, removable array<int>, erasable array<int>, requires array<struct<pos:int,needs:int>>, binders array<int>, occurs array<int>")
    out = argusage.shifted_usage(u, spark.createDataFrame([("a", 2), ("b", 2)], "key string, k int")).collect()
    assert [(r.key, r.arity, r.syntactic_arity, r.removable, [tuple(x) for x in r.requires], r.binders, r.occurs) for r in out] == [("a", 2, 1, [0, 1], [(0, 1)], [0], [1])]


@pytest.mark.parametrize("rule", ["is_copy", "is_pattern_lambda", "is_with_function", "is_kan_operation", "is_inline"])
def test_ignorable_flags(spark, rule):
    d = spark.createDataFrame([("A.f", "function", True), ("A.g", "function", False)], f"raw_name string, tag string, {rule} boolean")
    assert [r.raw_name for r in d.where(~filters.is_ignorable(d)).collect()] == ["A.g"]
