"""Operators on small literal tables, with results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import names, text
from weftgraph.operators import argusage, edges, filters, fixpoint, indexes, layout, rollups, terms
from weftgraph.sources import scan


def rows(df, *cols):
    return sorted((tuple(r) for r in (df.select(*cols) if cols else df).collect()), key=str)


def pairs(spark, *p, cols="src string, dst string"):
    return spark.createDataFrame(list(p), cols)


def test_names(spark):
    df = spark.createDataFrame([("M._.N", 3), ("M._", None), ("_+_", 7), ("A.b", 2)], "raw string, line int")
    got = {r.raw: (r.a, r.b, r.c) for r in df.select("raw", names.lifted(F.col("raw")).alias("a"), names.node_key(F.col("raw"), F.col("line")).alias("b"), names.short_name(F.col("raw")).alias("c")).collect()}
    assert got == {"M._.N": ("M.N", "M.N@3", "N"), "M._": ("M", "M", "_"), "_+_": ("_+_", "_+_", "_+_"), "A.b": ("A.b", "A.b", "b")}
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(names.under(F.lit("/a/project-old/x"), F.lit("/a/project"))) is False
    assert one(names.under(F.lit("/a/project/x"), F.lit("/a/project"))) is True
    assert one(names.prefixes(F.split(F.lit("A.B.C"), r"\."), ".")) == ["A", "A.B"]
    assert one(names.sanitised(F.lit("Ünï.x'-_;y"))) == "Ünï.x'-_"
    assert one(names.bigrams(F.lit("aaab"))) == ["aa", "ab"] and one(names.bigrams(F.lit("a"))) == []
    assert one(names.hex_colour(F.lit("#0a10FF"))) == (10, 16, 255) and one(names.hex_colour(F.lit("#0a10F"))) is None
    assert one(indexes.little_endian(F.array(F.lit(1), F.lit(256)))) == "AQAAAAABAAA="
    assert one(names.is_source(F.lit("x/A.lagda.md"))) and not one(names.is_source(F.lit("x/A.md")))


def test_comments(spark):
    one = lambda t: spark.range(1).select(text.without_block_comments(F.lit(t)).alias("x")).first().x
    assert one("a{-b{-c-}d-}e -} f") == "ae -} f"
    assert one("x {-# P #-} y\n{- z") == "x  y\n"
    assert one("") == ""


def test_headers(spark):
    files = spark.createDataFrame(
        [("p/A.agda", "-- module Z\n{- module Y -}\nmodule A where\nimport B.C using (x)\n  open import D -- import no\nopen  import D\nmodule E where"), ("p/B.lagda.md", "module _ where\nimport A"), ("p/C.agda", "no header\nimport A")],
        "file string, text string",
    )
    got = rows(scan.headers(scan.source_lines(files)))
    assert got == [("p/A.agda", "A", ["B.C", "D"]), ("p/B.lagda.md", "B.lagda", ["A"])]


def test_exclusion_and_ignorable(spark):
    df = spark.createDataFrame([("Data",), ("Data.List",), ("Database",)], "module string")
    assert rows(filters.excluded(df, spark.createDataFrame([("Data",)], "prefix string"))) == [("Database",)]
    d = spark.createDataFrame(
        [("A.f", "function", False), ("A.g", "function", True), ("A...x", "function", False), ("A.GeneralizeTel", "record", False), ("Agda.Primitive.Level", "axiom", False), ("A.p", "primitive", False), ("A.s", "primitive-sort", False)],
        "raw_name string, tag string, is_inline boolean",
    )
    assert rows(d.where(~filters.is_ignorable(d)).select("raw_name")) == [("A.f",)]


def test_contraction(spark):
    e = spark.createDataFrame([("a", "h", "body"), ("a", "b", "unknown"), ("h", "h2", "signature"), ("h2", "h", "body"), ("h2", "b", "signature"), ("h2", "c", "signature"), ("a", "h3", "signature"), ("h3", "c", "body")], "src string, dst string, prov string")
    ignored = spark.createDataFrame([("h",), ("h2",), ("h3",)], "key string")
    assert rows(edges.ignored_closure(e, ignored)) == [("h", "b"), ("h", "c"), ("h2", "b"), ("h2", "c"), ("h3", "c")]
    assert rows(edges.contracted(e, ignored), "src", "dst", "prov") == [("a", "b", "body"), ("a", "c", "signature")]


def test_providers(spark):
    e = spark.createDataFrame([("u", "m", "body"), ("u", "i", "signature")], "src string, dst string, prov string")
    impl = spark.createDataFrame([("m", "i"), ("m", "j"), ("i", "z")], "method_key string, binder_key string")
    assert rows(edges.with_providers(e, impl)) == [("u", "i", "signature"), ("u", "j", "unknown"), ("u", "m", "body"), ("u", "z", "unknown")]


def test_closure_on_cycles(spark):
    e = pairs(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"))
    assert rows(fixpoint.closure(e)) == sorted([(x, y) for x in "abc" for y in "abcd"], key=str)
    # b is reached from a's other successor only by way of a itself, and counts all the same
    e = pairs(spark, ("u", "v"), ("u", "w"), ("w", "u"))
    assert rows(fixpoint.transitive_edges(e)) == [("u", "v")]
    assert rows(fixpoint.transitive_edges(pairs(spark, ("a", "b"), ("b", "c"), ("a", "c")), 2)) == []


def test_depth_and_rank(spark):
    e = pairs(spark, ("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("b", "e"), ("x", "y"), ("y", "x"), ("a", "x"), ("z", "z"))
    nodes = spark.createDataFrame([(n,) for n in "abcdexyzq"], "node string")
    start = spark.createDataFrame([("a",)], "node string")
    assert dict(rows(fixpoint.bfs_depth(e, nodes, start))) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 2, "x": 1, "y": 2, "z": -1, "q": -1}
    assert dict(rows(fixpoint.bfs_depth(e, nodes, start.limit(0))))["a"] == -1
    # x and y are a cycle: x keeps the rank that a gave it
    assert dict(rows(fixpoint.longest_ranks(e, nodes))) == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3, "x": 1, "y": 0, "z": 0, "q": 0}


def test_layouts(spark):
    ranked = spark.createDataFrame([("a", 0), ("b", 2), ("c", 2)], "node string, rank int")
    assert rows(layout.pod_layout(ranked)) == [("a", -100.0, 0.0, 200.0, 52.0), ("b", -215.0, 132.0, 200.0, 52.0), ("c", 15.0, 132.0, 200.0, 52.0)]
    nodes = spark.createDataFrame([("k1", "M", 0), ("k2", "M", 1), ("k3", "N", 2)], "key string, module string, ord int")
    assert rows(layout.grid_layout(nodes)) == [("k1", 20.0, -20.0), ("k2", -20.0, -20.0), ("k3", 1000.0, 0.0)]


def test_spans(spark):
    s = spark.createDataFrame([("f", 1, 3), ("f", 3, 5), ("f", 7, 9), ("g", 2, 9), ("g", 3, 4)], "file string, lo long, hi long")
    assert rows(rollups.merged_spans(s)) == [("f", 1, 5), ("f", 7, 9), ("g", 2, 9)]
    p = spark.createDataFrame([("f", x, x) for x in (0, 1, 4, 5, 7, 9)] + [("g", 8, 8)], "file string, at long, id long")
    assert [r[2] for r in rows(rollups.in_spans(p, s))] == [1, 4, 7, 8]
    assert [r[1] for r in rows(rollups.in_spans(p, s, closed=True)) if r[0] == "f"] == [1, 4, 5, 7, 9]


def test_private_blocks(spark):
    def ranges(*lines):
        df = spark.createDataFrame([("f", i + 1, t) for i, t in enumerate(lines)], "file string, line_no int, text string")
        return sorted((r[1], r[2]) for r in rows(rollups.private_ranges(df)))

    assert ranges("module M where", "private", "  x = 1", "", "  private", "    y = 2", "", "z = 3", "  private", "w = 1", "private") == [(2, 7), (9, 9), (11, 11)]
    assert ranges("privateer = 1", "  private", "   a", " b", "  private") == [(2, 3), (5, 5)]


def test_rollups(spark):
    m = spark.createDataFrame([("A",), ("B",), ("C",)], "module string")
    n = spark.createDataFrame([("A", "D"), ("A", "H"), ("B", "P")], "module string, state string")
    failed = spark.createDataFrame([("B",)], "module string")
    assert rows(rollups.state_counts(n, m, failed), "module", "d", "p", "h", "f") == [("A", 1, 0, 1, 0), ("B", 0, 1, 0, 1), ("C", 0, 0, 0, 0)]
    owners = spark.createDataFrame([("A", "a.f"), ("A.B", "ab.f")], "owner string, file string")
    none = spark.createDataFrame([], "module string, file string")
    mods = spark.createDataFrame([("A.B.C",), ("A.X",), ("AB",)], "module string")
    assert rows(rollups.module_sources(mods, owners, none, none)) == [("A.B.C", "ab.f"), ("A.X", "a.f"), ("AB", None)]
    re_ = spark.createDataFrame([("H", "S", "x", None), ("H", "S", "y", "z"), ("H", "H", "q", None)], "host string, source string, name string, alias string")
    assert rows(edges.reexports(re_)) == [("H", "S", ["x", "z"], [("z", "y")])]


P = "key string, pos int, occurrence string, polarity string, hidden boolean"
FREE = "key string, view string, pos int, in_domain int"


def usage(spark, positions, free):
    p = spark.createDataFrame([(k, i, o, pol, h) for k, i, o, pol, h in positions], P)
    f = spark.createDataFrame([(k, v, i, j) for k, i, j in free for v in ("syntactic", "reduced")], FREE)
    left = argusage.removable(p, f)
    return [r[1] for r in rows(left)], [(r[1], r[2]) for r in rows(argusage.requires(left, f))]


def test_removable(spark):
    gone = lambda i, hidden=False: ("k", i, "Unused", "Nonvariant", hidden)
    used = lambda i, hidden=False: ("k", i, "Mixed", "Invariant", hidden)
    # a chain: 0 occurs in the domains of 1 and 3, which can all go
    assert usage(spark, [gone(0), gone(1), used(2), gone(3)], [("k", 0, 1), ("k", 0, 3)]) == ([0, 1, 3], [(0, 1), (0, 3)])
    assert usage(spark, [gone(0), used(1), gone(2)], []) == ([0, 2], [])
    assert usage(spark, [gone(0), gone(1)], [("k", 0, 1)]) == ([0, 1], [(0, 1)])
    # free in a domain that stays, or in the codomain: not removable; and what needs it goes down with it
    assert usage(spark, [gone(0), used(1)], [("k", 0, 1)]) == ([], [])
    assert usage(spark, [gone(0), gone(1)], [("k", 0, None)]) == ([1], [])
    # a hidden argument that could no longer be solved keeps the one that mentions it
    assert usage(spark, [used(0, True), gone(1)], [("k", 0, 1)]) == ([], [])
    assert usage(spark, [used(0, True), gone(1), used(2)], [("k", 0, 1), ("k", 0, 2)]) == ([1], [])
    assert usage(spark, [gone(0), gone(1), gone(2)], [("k", 0, 1), ("k", 1, 2)]) == ([0, 1, 2], [(0, 1), (0, 2), (1, 2)])
    assert usage(spark, [("k", 0, "Unused", "Covariant", False)], []) == ([], [])


def test_shift_and_body(spark):
    r = spark.createDataFrame([("k", 0), ("k", 2), ("j", 1)], "key string, pos int")
    assert rows(argusage.shifted(r, spark.createDataFrame([("k", 1), ("j", -3)], "key string, k int"))) == [("j", 1), ("k", 1)]
    removed = spark.createDataFrame([("k", 0), ("k", 1), ("k", 2), ("c", 0)], "key string, pos int")
    clauses = spark.createDataFrame([("k", 0, 0, "var", True), ("k", 0, 1, "dot", None), ("c", 0, None, None, None)], "key string, clause int, pos int, pattern string, free_in_body boolean")
    assert rows(argusage.occurs_in_body(removed, clauses)) == [("c", 0), ("k", 0), ("k", 2)]


def test_usage_rules(spark):
    u = spark.createDataFrame(
        [("ok", 4, 3, [0, 1], [2], [(0, 1)], [0], [1]), ("bad", 2, 3, [1], [], [(1, 0), (0, 5)], [1, 3], [0])],
        "key string, arity int, syntactic_arity int, removable array<int>, erasable array<int>, requires array<struct<pos:int,needs:int>>, binders array<int>, occurs array<int>",
    )
    got = rows(argusage.violations(u))
    assert {k for k, _ in got} == {"bad"} and len(got) == 8


def test_terms(spark):
    t = spark.createDataFrame(
        [(1, 0, None, 0, "app", "f"), (1, 1, 0, 0, "def", "x"), (1, 2, 0, 1, "con", "y"), (2, 0, None, 0, "app", "f"), (2, 5, 0, 0, "def", "x"), (2, 6, 0, 1, "con", "y"), (3, 0, None, 0, "app", "f"), (3, 1, 0, 1, "def", "x"), (3, 2, 0, 0, "con", "y")],
        "tree long, node long, parent long, ord int, tag string, name string",
    )
    h = {(r.tree, r.node): (r.hash, r.depth) for r in terms.fingerprints(t).collect()}
    assert h[1, 0] == h[2, 0] and h[1, 1] == h[2, 5] == h[3, 1] and h[3, 0] != h[1, 0] and h[1, 0][1] == 2
    ids = [(r.id, r.uses) for r in terms.hash_consed(t, ["tree", "node"]).orderBy("id").collect()]
    assert ids == [(0, 2), (1, 3), (2, 3), (3, 1)]
    assert rows(terms.references(t, spark.createDataFrame([(1,)], "tree long"))) == [(1, "x"), (1, "y")]
    with pytest.raises(ValueError):
        terms.fingerprints(spark.createDataFrame([(1, 0, 1, 0, "app", "f"), (1, 1, 0, 0, "app", "f")], t.schema))


def test_indexes(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"))
    got = indexes.indexed(df, ["v"]).collect()
    assert all(r.v == r.idx for r in got) and len(got) == 1000
    nodes = spark.createDataFrame([(0,), (1,), (2,)], "idx long")
    e = spark.createDataFrame([(2, 0, "body"), (0, 2, "signature"), (0, 1, "odd"), (0, 1, "odd")], "src long, dst long, prov string")
    assert rows(indexes.csr_offsets(nodes, e)) == [(0, 0), (1, 2), (2, 2), (3, 3)]
    assert rows(indexes.csr_targets(e)) == [(0, 0, 1, 4), (1, 0, 2, 0), (2, 2, 0, 1)]
    tree = rows(indexes.name_tree(spark.createDataFrame([("A.B.C",), ("A-x",), ("A",)], "name string"), ".", r"\."))
    assert tree == [("A", 0, -1, True), ("A-x", 3, -1, True), ("A.B", 1, 0, False), ("A.B.C", 2, 1, True)]
