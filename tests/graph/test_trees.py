"""Trees by folds and by tours, against plain recursion."""

import json
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import evidence, fixpoint, terms, trees

SCHEMA = "tree long, node long, parent long, ord long, tag string, name string"


def forest(r: random.Random, sizes):
    """Random trees; names of few kinds, so that subtrees repeat."""
    rows = []
    for t, n in enumerate(sizes):
        ids = r.sample(range(1000), n)
        for k, x in enumerate(ids):
            parent = None if k == 0 else ids[r.randrange(max(0, k - 4), k)]
            rows.append((t, x, parent, r.randrange(3), r.choice(["def", "app", "var"]), r.choice("ab")))
    return rows


def walked(rows):
    """(tree, node) -> pre, post, size, level, parent's pre."""
    below, out = {}, {}
    for t, x, p, o, _, _ in rows:
        below.setdefault((t, p), []).append((o, x))

    def go(t, x, level, up, count):
        count[0] += 1
        pre = count[0]
        for _, c in sorted(below.get((t, x), [])):
            go(t, c, level + 1, pre, count)
        count[1] += 1
        out[t, x] = (pre, count[1], count[0] - pre + 1, level, up)

    for t in {r[0] for r in rows}:
        count = [0, 0]
        for _, x in sorted(below[t, None]):
            go(t, x, 1, 0, count)
    return out


def placed(df):
    return {(r.tree, r.node): (r.pre, r.post, r.size, r.level, r.parent_pre) for r in df.collect()}


@pytest.fixture(scope="module")
def grown(spark):
    rows = forest(random.Random(8), [1, 2, 7, 40, 90])
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_numbers(spark, grown):
    rows, df = grown
    expected = walked(rows)
    assert placed(trees.numbered(df)) == expected
    assert placed(trees.toured(df)) == expected
    assert placed(trees.numbered(df, most=10)) == expected  # both ways at once
    assert trees.numbered(df.limit(0)).collect() == []
    two = spark.createDataFrame([(0, 1, None, 1, "a", ""), (0, 2, None, 0, "a", ""), (0, 3, 2, 0, "a", "")], SCHEMA)
    assert placed(trees.numbered(two)) == placed(trees.toured(two)) == {(0, 2): (1, 2, 2, 1, 0), (0, 3): (2, 1, 1, 2, 1), (0, 1): (3, 3, 1, 1, 0)}
    loop = spark.createDataFrame([(0, 0, None, 0, "a", ""), (0, 1, 2, 0, "a", ""), (0, 2, 1, 0, "a", "")], SCHEMA)
    with pytest.raises(Exception, match="leads back"):
        trees.numbered(loop).collect()
    with pytest.raises(ValueError, match="leads back"):
        trees.toured(loop)


def test_tours_in_pieces(spark, monkeypatch):
    """Trees in pieces of a few nodes, as large ones are, with names in no order; what whole trees take on disk is one sorted copy."""
    rows = forest(random.Random(9), [1, 30, 60, 2, 200, 9, 1])
    rows += [(7, x, None, 0, "a", "") for x in range(40)] + [(8, x, None if not x else 500, x, "a", "") for x in range(60)] + [(8, 500, 0, 0, "a", "")]
    df, expected = spark.createDataFrame(rows, SCHEMA), walked(rows)
    for batch in (1, 3, 11):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        try:
            assert placed(trees.toured(df, 4)) == expected
        finally:
            spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    text = [(t, f"n{x:03}", p if p is None else f"n{p:03}", *more) for t, x, p, *more in rows]
    got = placed(trees.toured(spark.createDataFrame(text, SCHEMA.replace("node long, parent long", "node string, parent string"))))
    assert {(t, int(x[1:])): v for (t, x), v in got.items()} == expected
    lost = spark.createDataFrame([(0, 0, None, 0, "a", ""), (0, 1, 9, 0, "a", "")], SCHEMA)
    with pytest.raises(ValueError, match="or to none"):
        trees.toured(lost)
    many = spark.range(3000).selectExpr("id div 3 as tree", "id % 3 as node", "if(id % 3 = 0, null, 0) as parent", "id as ord")
    kept = []
    monkeypatch.setattr(trees, "settled", lambda df: kept.append(fixpoint.settled(df)) or kept[-1])
    assert trees.toured(many).count() == 3000
    assert sum(df.count() for df in kept) < 2 * 3000


def test_budgets(spark, grown):
    rows, df = grown
    numbers = walked(rows)
    for budget in (0, 1, 5, 1000):
        got = {(r.tree, r.node): r.name for r in trees.limited(trees.numbered(df), budget).collect()}
        kept = {k for k, v in numbers.items() if v[0] <= budget}
        cut = {(t, x) for t, x, p, *_ in rows if (t, x) not in kept and (p is None or (t, p) in kept)}
        assert set(got) == kept | cut and all(got[k] == trees.CUT_NAME for k in cut)
    sorts = spark.createDataFrame([(0, 0, None, 0, "unsupported", "sort:PiSort x y"), (0, 1, 0, 0, "unsupported", "meta:1 2")], SCHEMA)
    assert sorted(r.name for r in trees.limited(trees.numbered(sorts), 9).collect()) == ["meta:1 2", "sort:PiSort"]


def test_contents_of_large_trees(grown):
    _, df = grown
    own = F.concat_ws("|", "tag", "name")
    key = lambda r: (r.tree, r.node, r.hash, r.depth, tuple(r.kids))
    for by_node in (False, True):
        assert sorted(map(key, trees.contents(df, own, by_node=by_node).collect())) == sorted(map(key, trees.contents(df, own, most=5, by_node=by_node).collect()))


def test_shared_nodes(spark, grown):
    _, df = grown
    shared, roots = terms.interned(df)
    rows = {r.id: r for r in shared.collect()}
    assert sorted(rows) == list(range(len(rows)))
    assert all(c < i for i, r in rows.items() for c in r.children)
    assert len({(r.tag, r.name, tuple(r.children)) for r in rows.values()}) == len(rows)
    assert sum(r.uses for r in rows.values()) == df.count()
    back = sorted((r.tree, r.path, r.tag, r.name) for r in terms.decoded(shared, roots).collect())
    assert back == sorted((r.tree, r.path, r.tag, r.name) for r in terms.paths(df).collect())
    # selected owners in an order of their own: as if nothing else had been there
    owners = spark.createDataFrame([(4, 0), (2, 1)], "tree long, place int")
    some, their = terms.interned(df, owners)
    assert {r.id for r in some.collect()} == set(range(some.count()))
    assert {r.tree for r in their.collect()} == {2, 4}
    first = terms.interned(df.where("tree = 4"))[0].select("id", "tag", "name", "children")
    n = first.count()
    assert sorted(map(tuple, some.where(F.col("id") < n).select("id", "tag", "name", "children").collect())) == sorted(map(tuple, first.collect()))


def test_nested_values(grown):
    _, df = grown
    values = terms.nested(df)
    texts = {r.tree: json.loads(r.value) for r in values.collect()}
    assert set(texts) == {0, 1, 2, 3, 4} and set(texts[0]) == {"tag", "name", "info", "binds", "children"}
    back = sorted((r.tree, r.path, r.tag, r.name) for r in terms.unnested(values).collect())
    assert back == sorted((r.tree, r.path, r.tag, r.name) for r in terms.paths(df).collect())


def test_syntax(spark):
    """The type of a function, an application with projections, and what can't be encoded."""
    rows = [
        # (A : Set) -> f x .p, in a type
        (1, 0, None, 0, "type", "", True), (1, 1, 0, 0, "pi", "A", True), (1, 2, 1, 0, "type", "", True), (1, 3, 2, 0, "univ", "Set", True), (1, 4, 3, 0, "level", "0", True), (1, 5, 2, 1, "sort-inf", "Set:0", True),
        (1, 6, 1, 1, "def", "f", True), (1, 7, 6, 0, "apply", "", True), (1, 8, 7, 0, "var", "0", True), (1, 9, 6, 1, "proj", "p", True), (1, 10, 0, 1, "sort-constant", "SizeUniv", True),
        # an odd argument: all before it is gone, what follows stays
        (2, 0, None, 0, "var", "3", True), (2, 1, 0, 0, "apply", "", True), (2, 2, 1, 0, "lit", "1", True), (2, 3, 0, 1, "apply", "", False), (2, 4, 3, 0, "lit", "2", True), (2, 5, 0, 2, "apply", "", True), (2, 6, 5, 0, "lit-name", "q", True),
        (3, 0, None, 0, "pi", "x", False), (3, 1, 0, 0, "type", "", True), (3, 2, 1, 0, "var", "1", True), (3, 3, 0, 1, "lam", "y", False), (3, 4, 3, 0, "var", "0", True),
        (4, 0, None, 0, "con", "c", True), (4, 1, 0, 0, "iapply", "", True), (5, 0, None, 0, "meta", "7", True), (6, 0, None, 0, "dont-care", "", True), (6, 1, 0, 0, "sort", "Pi", True),
        (7, 0, None, 0, "binder", "z", False), (7, 1, 0, 0, "type", "", True), (7, 2, 1, 0, "var", "0", True),
    ]
    raw = spark.createDataFrame(rows, "tree long, node long, parent long, ord long, kind string, text string, plain boolean").withColumns({"info": F.array(F.lit("NotHidden")), "binds": F.col("kind").isin("pi", "lam")})
    made = terms.encoded(raw)
    leaf = lambda tag, name="": (tag, name, [])
    shape = lambda v: (v["tag"], v["name"], [shape(c) for c in v["children"]])
    values = {r.tree: json.loads(r.value) for r in terms.nested(made).collect()}
    applied = ("proj", "p", [("app", "", [leaf("def", "f"), leaf("var", "0")])])
    assert shape(values[1]) == ("type", "", [("pi", "A", [("type", "", [("sort", "Set", [leaf("level", "0")]), leaf("sort-inf", "Set:0")]), applied]), leaf("sort-constant", "SizeUniv")])
    assert shape(values[2]) == ("app", "", [leaf("unsupported", terms.APPLICATION), leaf("lit", "LitQName q")])
    assert shape(values[3]) == ("pi", "x", [leaf("unsupported", terms.PI), leaf("unsupported", terms.LAMBDA)])
    assert shape(values[4]) == leaf("unsupported", terms.CUBICAL) and shape(values[5]) == leaf("unsupported", "meta:7")
    assert shape(values[6]) == ("irrelevant", "", [leaf("unsupported", "sort:Pi")])
    assert shape(values[7]) == ("binder", "z", [leaf("unsupported", terms.CONTEXT)])
    pi = values[1]["children"][0]
    assert pi["info"] == ["NotHidden"] and pi["binds"] and not values[1]["binds"] and values[1]["info"] == []


def test_copies(spark):
    chain = [(f"c{k}", f"c{k + 1}") for k in range(70)] + [("x", "y"), ("y", "x"), ("self", "self"), ("one", "real")]
    copies = spark.createDataFrame(chain, "copy string, target string")

    def followed(name, fuel, to=dict(chain)):
        for _ in range(fuel):
            name = to.get(name, name)
        return name

    for fuel in (64, 1, 5, 0):
        assert {r.copy: r.original for r in terms.copies_removed(copies, fuel).collect()} == {c: followed(c, fuel) for c, _ in chain}
    nodes = spark.createDataFrame([(0, 0, None, 0, "def", "c60"), (0, 1, 0, 0, "var", "c60"), (0, 2, 0, 1, "def", "other")], SCHEMA)
    assert {r.node: r.name for r in terms.without_copies(nodes, copies).collect()} == {0: "c70", 1: "c60", 2: "other"}


def test_capture(spark):
    d = [("r", "M", 5, None), ("big", "M", 99, None), ("a1", "M", 1, None), ("a2", "M", 1, None), ("deep", "M", 1, None), ("ex", "X.Y", 1, None), ("eq1", "M", 1, None), ("eq2", "M", 1, None), ("eq3", "M", 50, None), ("s1", "M", 1, 3), ("s2", "M", 1, 3), ("far", "M", 1, 999)]
    refs = [("r", "a1"), ("r", "a2"), ("r", "gone"), ("r", "ex"), ("a1", "deep"), ("eq1", "s1"), ("eq1", "s2"), ("eq1", "far"), ("eq1", "eq2")]
    got = evidence.capture(
        spark.createDataFrame(d, "key string, module string, nodes int, body_nodes int"),
        spark.createDataFrame(refs, "src string, dst string"),
        spark.createDataFrame([("r",), ("big",)], "key string"),
        spark.createDataFrame([("eq1",), ("eq2",), ("eq3",)], "key string"),
        spark.createDataFrame([("X",)], "prefix string"),
        evidence.Limits(depth=1, auxiliaries=1, nodes=10, equations=1, supports=2),
    )
    assert {r.key: (r.role, r.reason) for r in got.collect()} == {
        "r": ("selected-root", None), "a1": ("auxiliary", None), "eq1": ("equation-signature", None), "s1": ("support", None),
        "big": ("omitted", "signature-node-limit"), "a2": ("omitted", "auxiliary-limit"), "gone": ("omitted", "unavailable-definition"), "ex": ("omitted", "excluded-module"),
        "deep": ("omitted", "closure-depth"), "eq2": ("omitted", "equation-signature-limit"), "eq3": ("omitted", "equation-signature-node-limit"), "s2": ("omitted", "support-limit"),
    }


def test_equations_of_large_trees(spark, monkeypatch):
    rows = [(0, 0, None, 0, "pi", ""), (0, 1, 0, 0, "def", "no"), (0, 2, 0, 1, "app", ""), (0, 3, 2, 0, "app", ""), (0, 4, 3, 0, "def", "eq"), (1, 0, None, 0, "app", ""), (1, 1, 0, 0, "type", ""), (1, 2, 1, 0, "def", "eq"), (2, 0, None, 0, "def", "eq"), (3, 0, None, 0, "type", ""), (3, 1, 0, 0, "def", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.tree for r in evidence.equation_signatures(df, "eq").collect()) == [0, 2]
    monkeypatch.setattr(trees, "TREE_NODES", 1)
    assert sorted(r.tree for r in evidence.equation_signatures(df, "eq").collect()) == [0, 2]
