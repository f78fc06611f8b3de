"""Term trees: fingerprints, sharing, references, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import settled, union_all
from weftgraph.operators.indexes import indexed
from weftgraph.operators.trees import contents, folded, numbered, numbered_contents

LEVEL_KEYS = ["tree", "node"]
# Heads that eliminations are applied to, and the reasons of what can't be encoded.
HEADS = ("var", "def", "con")
LAMBDA, PI, APPLICATION, CUBICAL, CONTEXT = "lambda-modality", "pi-modality-or-finite-domain", "application-modality", "cubical-application", "context-modality-or-finite-domain"
#: Times that a copy of a definition is replaced by what it copies.
FUEL = 64


def fingerprints(nodes: DataFrame, min_depth: int = 1) -> DataFrame:
    """(tree, node, hash, depth) of nodes (tree, node, parent, ord, tag, name): equal subtrees have equal hashes; those of min_depth at least.

    Binder names and ids do not count: the hash covers tags, referenced names with their lengths, and
    the children's hashes in order. Depth is 1 for leaves.
    """
    at = nodes.select("tree", "node", "parent", "ord", F.concat_ws(":", "tag", F.length("name"), "name").alias("text"))
    return contents(at, F.col("text")).where(F.col("depth") >= min_depth).select("tree", "node", "hash", "depth")


def hash_consed(nodes: DataFrame, first_seen: list[str]) -> DataFrame:
    """(id, hash, uses): one id per distinct subtree, numbered by first appearance in the order of first_seen."""
    prints = fingerprints(nodes)
    more = [c for c in first_seen if c not in LEVEL_KEYS]
    if more:
        prints = prints.join(nodes.select(*LEVEL_KEYS, *more), LEVEL_KEYS)
    once = prints.groupBy("hash").agg(F.min(F.struct(*first_seen)).alias("first"), F.count("*").alias("uses"))
    return indexed(once, ["first"], "id").select("id", "hash", "uses")


def _whole(nodes: DataFrame) -> DataFrame:
    """nodes with info and binds, empty and false if there are none."""
    if "info" not in nodes.columns:
        nodes = nodes.withColumn("info", F.array().cast("array<string>"))
    return nodes if "binds" in nodes.columns else nodes.withColumn("binds", F.lit(False))


def interned(nodes: DataFrame, owners: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(the shared nodes (id, tag, name, info, binds, children, uses), the roots (tree, node, id)) of trees.

    Equal subtrees are one shared node, named by a digest of its content. Ids go by first appearance, trees in the order of
    owners (tree, place), of equals by tree, and children before their parent; so a child's id is always smaller. With owners,
    only their trees are taken: numbering selected ones anew is the same as interning nothing else.
    """
    at = _whole(nodes).select("tree", "node", "parent", "ord", "tag", "name", "info", "binds")
    if owners is None:
        at = at.withColumn("place", F.lit(0))
    else:
        at = at.join(owners.groupBy("tree").agg(F.min("place").alias("place")), "tree")
    made = numbered_contents(at, F.to_json(F.struct("tag", "name", "info", "binds")), every=nodes)
    made = settled(made.select("tree", "node", F.col("parent").isNull().alias("top"), "place", "post", "tag", "name", "info", "binds", F.unhex("hash").alias("hash"), F.transform("kids", F.unhex).alias("kids")))
    first = F.min(F.struct("place", "tree", "post")).alias("first")
    once = made.groupBy("hash").agg(first, *[F.any_value(c).alias(c) for c in ("tag", "name", "info", "binds", "kids")], F.count("*").alias("uses"))
    ids = settled(indexed(once, ["first"], "id"))
    known = ids.select(F.col("hash").alias("kid"), F.col("id").alias("kid_id"))
    below = ids.select("id", F.posexplode("kids").alias("k", "kid")).join(known, "kid").groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "kid_id"))), lambda s: s["kid_id"]).alias("children"))
    shared = ids.join(below, "id", "left").select("id", "tag", "name", "info", "binds", F.coalesce("children", F.array().cast("array<bigint>")).alias("children"), "uses")
    roots = made.where("top").join(ids.select("hash", "id"), "hash").select("tree", "node", "id")
    return shared, roots


def decoded(shared: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, path, tag, name, info, binds): the trees of roots (tree, id) again, each node by the places of the children on its way from the root."""
    dag = settled(shared.select("id", "tag", "name", "info", "binds", "children"))
    new, out = roots.select("tree", F.array().cast("array<int>").alias("path"), "id"), []
    while True:
        at = settled(new.join(dag, "id"))
        if at.isEmpty() and out:
            return union_all(out)
        out.append(at.select("tree", "path", "tag", "name", "info", "binds"))
        new = at.select("tree", "path", F.posexplode("children").alias("k", "id")).select("tree", F.concat("path", F.array("k")).alias("path"), "id")


def paths(nodes: DataFrame) -> DataFrame:
    """nodes with path: the places among their siblings (by ord, of equals by node) of those on the way from the root, as decoded has them."""
    kid = F.row_number().over(W.partitionBy("tree", "parent").orderBy("ord", "node")) - 1
    placed = settled(nodes.withColumn("k", F.when(F.col("parent").isNotNull(), kid)))
    new, out = placed.where("parent is null").withColumn("path", F.array().cast("array<int>")), []
    while not new.isEmpty():
        out.append(new)
        above = new.select("tree", F.col("node").alias("parent"), "path")
        new = settled(placed.join(above, ["tree", "parent"]).select(*placed.columns, F.concat("path", F.array("k")).alias("path")))
    return union_all(out).drop("k") if out else placed.withColumn("path", F.array().cast("array<int>")).drop("k")


def references(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Distinct (tree, name) of definitions, constructors and projections in the trees of roots (tree)."""
    return nodes.where(F.col("tag").isin("def", "con", "proj")).join(roots.select("tree").distinct(), "tree", "left_semi").select("tree", "name").distinct()


def copies_removed(copies: DataFrame, fuel: int = FUEL) -> DataFrame:
    """(copy, original) of copies (copy, target), where a target may be a copy itself: what fuel replacements lead to.

    Pointers jump over twice as many copies each round, so chains of any shape take as many rounds as fuel has binary
    digits; a circle ends where the fuel does. Of repeated copies the least target holds.
    """
    jump = settled(copies.groupBy("copy").agg(F.min("target").alias("to")))
    out = jump.select("copy", F.col("copy").alias("to"))
    left = fuel
    while True:
        if left & 1:
            ahead = jump.select(F.col("copy").alias("to"), F.col("to").alias("then"))
            out = settled(out.join(ahead, "to", "left").select("copy", F.coalesce("then", "to").alias("to")))
        left >>= 1
        if not left:
            return out.select("copy", F.col("to").alias("original"))
        ahead = jump.select(F.col("copy").alias("to"), F.col("to").alias("then"))
        jump = settled(jump.join(ahead, "to", "left").select("copy", F.coalesce("then", "to").alias("to")))


def without_copies(nodes: DataFrame, copies: DataFrame, fuel: int = FUEL) -> DataFrame:
    """Terms in whose definitions (tag def) names of copies are replaced by their originals."""
    to = copies_removed(copies, fuel).select(F.col("copy").alias("name"), "original")
    named = nodes.join(to, "name", "left")
    return named.withColumn("name", F.when(F.col("tag") == "def", F.coalesce("original", "name")).otherwise(F.col("name"))).select(*nodes.columns)


def encoded(raw: DataFrame) -> DataFrame:
    """Nodes (tree, node, parent, ord, tag, name, info, binds) of syntax rows (tree, node, parent, ord, kind, text, info, plain, binds).

    Kinds: heads var, def, con, whose children are eliminations apply (of one argument), proj and iapply; lam (body), pi
    (domain, codomain), type (term, sort); univ (level), sort-inf, sort-constant, sort; level (its sums), plus (term); lit,
    lit-name, dont-care (term), meta, dummy; binder (type) of a telescope. plain says that a binder or argument has no
    modality that trees can't say. Eliminations nest to the left: the last is outermost. What can't be encoded is a leaf
    unsupported with its reason, and nothing below it stays; of an eliminated term that is all up to the last such elimination.
    """
    at = numbered(raw)
    above = at.select("tree", F.col("node").alias("parent"), F.col("kind").alias("up_kind"), F.col("plain").alias("up_plain"), F.col("parent").alias("up_parent"))
    at = at.join(above, ["tree", "parent"], "left")
    siblings = W.partitionBy("tree", "parent")
    elim = F.col("up_kind").isin(*HEADS)
    bad = elim & ((F.col("kind") == "iapply") | (F.col("kind") == "apply") & ~F.col("plain"))
    at = at.withColumn("i", F.when(elim, F.row_number().over(siblings.orderBy("ord", "node"))))
    at = at.withColumns({"k": F.when(elim, F.count("*").over(siblings)), "last_bad": F.when(elim, F.coalesce(F.max(F.when(bad, F.col("i"))).over(siblings), F.lit(0)))})
    # rows that go with all that is below them: up to the last bad elimination, bodies of odd lambdas, and what is below an odd domain
    odd_domain = (F.col("up_kind") == "pi") & ~F.col("up_plain") & (F.col("ord") == F.min("ord").over(siblings))
    odd_binder = (F.col("up_kind") == "binder") & ~F.col("up_plain")
    leaf = odd_domain | odd_binder
    drops = F.coalesce(elim & (F.col("i") <= F.col("last_bad")) | (F.col("up_kind") == "lam") & ~F.col("up_plain"), F.lit(False))
    at = at.withColumns({"leaf": F.coalesce(leaf, F.lit(False)), "drops": drops})
    # where a row's subtree goes, all places up to its end do: a running maximum over the tree in pre-order
    end = F.col("pre") + F.col("size")
    before = W.partitionBy("tree").orderBy("pre")
    gone = F.max(F.when(F.col("drops") | F.col("leaf"), end)).over(before.rowsBetween(W.unboundedPreceding, -1))
    at = settled(at.withColumn("kept", ~F.col("drops") & (F.coalesce(gone, F.lit(0)) <= F.col("pre"))))
    heads = at.where(F.col("i").isNotNull() & (F.col("i") == F.col("k"))).select("tree", F.col("parent").alias("node"), F.col("k").alias("n_elims"), "last_bad")
    worst = at.where("i = last_bad").select("tree", F.col("parent").alias("node"), F.when(F.col("kind") == "iapply", CUBICAL).otherwise(APPLICATION).alias("reason"))
    own = at.where("kept").drop("k", "last_bad").join(heads, ["tree", "node"], "left").join(worst, ["tree", "node"], "left")
    step = lambda node, i: F.concat(node.cast("string"), F.lit("."), i.cast("string"))
    zero = F.lit(0)
    # a row's outermost node; above it is the application it is an argument of, or its parent
    arg = F.col("up_kind") == "apply"
    elims = at.where("i is not null").select("tree", F.col("node").alias("parent"), F.col("i").alias("up_i"))
    own = own.join(elims, ["tree", "parent"], "left")
    up = F.when(F.col("parent").isNull(), F.lit(None)).when(arg, step(F.col("up_parent"), F.col("up_i"))).otherwise(step(F.col("parent"), zero))
    place = F.when(arg, 1).otherwise(F.col("ord")).cast("long")
    base, top = F.coalesce("last_bad", zero), F.coalesce("n_elims", zero)
    inner = base < top
    is_elim = F.col("i").isNotNull()
    unsupported = F.col("reason").isNotNull() | F.col("leaf") | (F.col("kind").isin("meta", "dummy", "sort")) | (F.col("kind") == "lam") & ~F.col("plain")
    why = F.coalesce("reason", F.when(F.col("leaf"), F.when(F.col("up_kind") == "pi", PI).otherwise(CONTEXT)).when(F.col("kind") == "lam", LAMBDA).otherwise(F.concat("kind", F.lit(":"), "text")))
    tag = F.when(unsupported, "unsupported").when(F.col("kind") == "univ", "sort").when(F.col("kind") == "plus", "level-plus").when(F.col("kind") == "lit-name", "lit").when(F.col("kind") == "dont-care", "irrelevant").otherwise(F.col("kind"))
    name = F.when(unsupported, why).when(F.col("kind") == "lit-name", F.concat(F.lit("LitQName "), "text")).when(F.col("kind").isin("type", "dont-care"), "").otherwise(F.col("text"))
    binder = ~unsupported & F.col("kind").isin("lam", "pi", "binder")
    no_info = F.array().cast("array<string>")
    bases = own.where(~is_elim).select(
        "tree",
        step(F.col("node"), base).alias("node"),
        F.when(inner, step(F.col("node"), base + 1)).otherwise(up).alias("parent"),
        F.when(inner, 0).otherwise(place).cast("long").alias("ord"),
        tag.alias("tag"),
        name.alias("name"),
        F.when(binder, F.col("info")).otherwise(no_info).alias("info"),
        (binder & F.col("kind").isin("lam", "pi") & F.col("binds")).alias("binds"),
    )
    outer = at.select("tree", F.col("node").alias("parent"), F.col("parent").alias("head_parent"), F.col("up_kind").alias("head_up"), F.col("up_parent").alias("head_up_parent"), F.col("ord").alias("head_ord"))
    outer = outer.join(elims.select("tree", F.col("parent").alias("head_parent"), F.col("up_i").alias("head_i")), ["tree", "head_parent"], "left")
    chain = at.where("kept and i is not null").join(outer, ["tree", "parent"])
    ends = F.col("i") == F.col("k")
    head_arg = F.col("head_up") == "apply"
    over = F.when(F.col("head_parent").isNull(), F.lit(None)).when(head_arg, step(F.col("head_up_parent"), F.col("head_i"))).otherwise(step(F.col("head_parent"), zero))
    steps = chain.select(
        "tree",
        step(F.col("parent"), F.col("i")).alias("node"),
        F.when(ends, over).otherwise(step(F.col("parent"), F.col("i") + 1)).alias("parent"),
        F.when(~ends, 0).when(head_arg, 1).otherwise(F.col("head_ord")).cast("long").alias("ord"),
        F.when(F.col("kind") == "apply", "app").otherwise(F.col("kind")).alias("tag"),
        F.when(F.col("kind") == "apply", "").otherwise(F.col("text")).alias("name"),
        F.when(F.col("kind") == "apply", F.col("info")).otherwise(no_info).alias("info"),
        F.lit(False).alias("binds"),
    )
    return bases.unionByName(steps)


def nested(nodes: DataFrame) -> DataFrame:
    """(tree, value): each tree as one JSON object with its children in it, from the leaves up; nodes as of encoded, within a node budget (see trees.limited)."""

    def fold(node, parent, own):
        at = {x: k for k, x in enumerate(node)}
        below, roots = [[] for _ in node], []
        for k, p in enumerate(parent):
            (roots if p is None else below[at[p]]).append(k)
        order, open_ = [], list(roots)
        while open_:
            order.append(open_.pop())
            open_ += below[order[-1]]
        made = [None] * len(node)
        for k in reversed(order):
            made[k] = own[k][:-1] + ',"children":[' + ",".join(made[c] for c in below[k]) + "]}"
            for c in below[k]:
                made[c] = None
        return ([made[k] if k in set(roots) else None for k in range(len(node))],)

    at = _whole(nodes).select("tree", "node", "parent", "ord", F.to_json(F.struct("tag", "name", "info", "binds")).alias("own"))
    return folded(at, ["node", "parent", "own"], fold, "value string").where("value is not null").select("tree", "value")


def unnested(values: DataFrame, column: Column | None = None) -> DataFrame:
    """(tree, path, tag, name, info, binds) of nested values (tree, value), read level by level with Spark's own JSON reader."""
    shape = "tag string, name string, info array<string>, binds boolean, children array<string>"
    new, out = values.select("tree", F.array().cast("array<int>").alias("path"), F.col("value") if column is None else column.alias("value")), []
    while True:
        at = settled(new.select("tree", "path", F.from_json("value", shape).alias("v")).select("tree", "path", "v.*"))
        if at.isEmpty() and out:
            return union_all(out)
        out.append(at.drop("children"))
        new = at.select("tree", "path", F.posexplode("children").alias("k", "value")).select("tree", F.concat("path", F.array("k")).alias("path"), "value")
