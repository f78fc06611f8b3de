"""What queries leave on disk while they run."""

import os
import time

from pyspark.sql import functions as F

from weftgraph.operators import edges, evidence, fixpoint, terms, trees


def shuffled(spark):
    """Bytes of shuffle files of this session."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return sum(os.path.getsize(f) for f in files if "shuffle_" in f and os.path.exists(f))


def test_shuffles_of_a_settled_table_go_at_once(spark):
    before = shuffled(spark)
    out = fixpoint.settled(spark.range(300_000).select(F.sha1(F.col("id").cast("string")).alias("x")).distinct())
    for _ in range(50):  # files go a moment later
        if shuffled(spark) <= before:
            break
        time.sleep(0.2)
    assert shuffled(spark) <= before
    assert spark.conf.get(fixpoint.SHUFFLES_GO) == "false" and out.count() == 300_000


def test_a_settled_table_is_not_copied_by_the_fixpoint_that_begins_with_it(spark, monkeypatch):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (2, 3)], "src int, dst int")
    rows, real = [], fixpoint.settled
    monkeypatch.setattr(fixpoint, "settled", lambda df: rows.append((out := real(df)).count()) or out)
    assert sorted(map(tuple, fixpoint.closure(e).collect())) == [(a, b) for a in (1, 2, 3) for b in (1, 2, 3)]
    assert rows == [3, 3, 3, 0]


def test_providers_are_shuffled_as_lists(spark):
    """Methods have a few implementations, or many; null keys equal nothing, and each row is there once."""
    e = spark.range(40_000).select(F.concat(F.lit("source."), F.expr("id div 4")).alias("src"), F.concat(F.lit("method."), F.col("id") * 7919 % 3001).alias("dst"), F.lit("body").alias("prov"))
    impl = spark.range(24_008).select(F.concat(F.lit("method."), F.col("id") % 3001).alias("method_key"), F.concat(F.lit("binder."), F.xxhash64("id") % 5000).alias("binder_key"))
    n = {}
    for name, make in (("lists", lambda: edges.with_providers(e, impl)), ("pairs", lambda: e.join(impl.withColumnRenamed("method_key", "dst"), "dst").select("src", "binder_key").distinct())):
        made, before = make(), shuffled(spark)
        made.write.format("noop").mode("overwrite").save()
        n[name] = shuffled(spark) - before
    assert n["lists"] < 0.7 * n["pairs"]
    odd = spark.createDataFrame([("a", "m", "body"), ("a", "m", "signature"), (None, "m", "body"), (None, "x", "body"), ("a", "y", "body"), ("b", None, "body")], "src string, dst string, prov string")
    by = spark.createDataFrame([("m", "x"), ("m", "x"), ("m", "y"), ("m", None), (None, "z")], "method_key string, binder_key string")
    new = [("a", "x", "unknown"), ("a", None, "unknown"), (None, "x", "unknown"), (None, "y", "unknown"), (None, None, "unknown")]
    assert sorted(map(str, map(tuple, edges.with_providers(odd, by).collect()))) == sorted(map(str, [*map(tuple, odd.collect()), *new]))
    wide = spark.range(200).select(F.lit("m").alias("method_key"), F.col("id").cast("string").alias("binder_key"))
    assert edges.with_providers(odd, wide).where("src = 'a' and prov = 'unknown'").count() == 200


def test_implied_edges_keep_few_copies_of_the_edges(spark, monkeypatch):
    """Sources that nothing leads to, as most are, are stored once; a hub that all of them lead to goes on."""
    e = spark.range(3000).select(F.concat(F.lit("s"), F.expr("id div 3")).alias("src"), F.concat(F.lit("t"), F.expr("id % 3")).alias("dst"))
    e = e.unionByName(spark.createDataFrame([("t0", "u"), ("t1", "t0")], "src string, dst string"))
    rows, real = [], fixpoint.settled
    monkeypatch.setattr(fixpoint, "settled", lambda df: rows.append((out := real(df)).count()) or out)
    got = {(r.src, r.dst) for r in fixpoint.transitive_edges(e).collect()}
    assert got == {(f"s{k}", "t0") for k in range(1000)}
    assert sum(rows) < 3 * e.count(), rows


def test_a_capture_stores_no_row_of_its_last_step(spark, monkeypatch):
    """Three steps at most, over a graph with circles; the rows of the first are stored once."""
    e = spark.range(300).selectExpr("cast(id as int) as src", "cast(id % 10 as int) as dst").where("src != dst").unionByName(spark.createDataFrame([(k, (k + 1) % 10) for k in range(10)], "src int, dst int"))
    pairs = {tuple(r) for r in e.collect()}
    after = {}
    for a, b in pairs:
        after.setdefault(a, set()).add(b)
    for depth in (1, 2, 3):
        want = {}
        for root in after:
            at = {root}
            for d in range(1, depth + 1):
                at = {b for a in at for b in after.get(a, ())}
                for b in at:
                    want.setdefault((root, b), d)
        rows, real = [], fixpoint.settled
        monkeypatch.setattr(evidence, "settled", lambda df, rows=rows, real=real: rows.append((out := real(df)).count()) or out)
        got = evidence.captured(e, depth=depth, most=2)
        assert {(r.src, r.dst): r.d for r in got.collect()} == want
        by = {}
        for (a, b), d in want.items():
            by.setdefault(a, []).append((d, b))
        assert {(r.src, r.dst) for r in got.where("status = 'captured'").collect()} == {(a, b) for a, x in by.items() for _, b in sorted(x)[:2]}
        if depth == 2:
            assert sum(rows) < 1.5 * len(pairs), rows


def test_shared_terms_are_dealt_to_tasks_once(spark):
    """Numbers and digests come from one pass over the sorted trees, with or without owners, and the terms come back whole."""
    nodes = spark.range(400).selectExpr("id div 4 as tree", "id % 4 as node", "if(id % 4 = 0, null, 0) as parent", "id % 4 as ord", "'app' as tag", "if(id % 4 = 3, 'x', concat('n', id div 8 % 5)) as name")
    made = trees.numbered_contents(nodes, F.concat("tag", "name"))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    apart = trees.contents(trees.numbered(nodes), F.concat("tag", "name"), by_node=True)
    key = lambda r: (r.tree, r.node, r.pre, r.post, r.size, r.level, r.parent_pre, r.hash, r.depth, tuple(r.kids))
    assert sorted(map(key, made.collect())) == sorted(map(key, apart.collect())) == sorted(map(key, trees.numbered_contents(nodes, F.concat("tag", "name"), most=2).collect()))
    owners = spark.range(50).select(F.col("id").alias("tree"), (-F.col("id")).alias("place"))
    back = terms.decoded(*terms.interned(nodes, owners))
    want = nodes.where("tree < 50").selectExpr("tree", "if(node = 0, '', cast(node - 1 as string)) as path", "tag", "name")
    got = back.select("tree", F.array_join("path", "/").alias("path"), "tag", "name")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_trees_are_counted_before_they_meet_their_owners(spark, monkeypatch):
    """A join of nothing but trees' numbers, which pack densely, is what a task of large tables had no memory for."""
    nodes = spark.range(400).selectExpr("id div 4 as tree", "id % 4 as node", "if(id % 4 = 0, null, 0) as parent", "id % 4 as ord", "'app' as tag", "'x' as name")
    plans, real = [], trees.settled
    monkeypatch.setattr(trees, "settled", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or real(df))
    shared, roots = terms.interned(nodes, spark.range(50).select(F.col("id").alias("tree"), F.lit(0).alias("place")))
    assert plans and "Join" not in plans[0]
    assert roots.count() == 50 and sorted(r.uses for r in shared.collect()) == [50, 150]
    monkeypatch.setattr(trees, "TREE_NODES", 2)
    assert sorted(r.uses for r in terms.interned(nodes, spark.range(3).select(F.col("id").alias("tree"), F.lit(0).alias("place")))[0].collect()) == [3, 9]
