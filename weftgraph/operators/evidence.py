"""Evidence about terms: what a bounded capture takes, what it leaves out and why, occurrences and their paths.

Trees are rows (tree, node, parent, ord, tag, name): an application has its function at 0 and its argument at 1.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.names import prefixes
from weftgraph.operators.fixpoint import closure, grow, settled, union_all
from weftgraph.operators.indexes import indexed
from weftgraph.operators.trees import by_size, folded

# Limits of a capture, of a tree, and of the catalogue of equations.
CLOSURE_DEPTH, AUXILIARIES, ROOT_NODES, EQUATIONS, SUPPORTS, SUPPORT_NODES = 2, 512, 10_000, 2048, 64, 128
NODE = ["tree", "node"]


def captured(edges: DataFrame, depth: int = CLOSURE_DEPTH, most: int = AUXILIARIES, roots: DataFrame | None = None) -> DataFrame:
    """(src, dst, d, status) of what a root (src) leads to in depth steps: the nearest most are captured, of equals by name; others are capped."""
    e = settled(edges.select("src", "dst").distinct())
    start = e if roots is None else settled(e.join(roots.select("src").distinct(), "src", "left_semi"))
    # only steps from what some edge leads to are ever taken
    hop = settled(e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select(F.col("src").alias("dst"), F.col("dst").alias("next")))
    new = start.withColumn("d", F.lit(1))
    found = [new]
    for k in range(2, depth + 1):
        new = new.join(hop, "dst").select("src", F.col("next").alias("dst"), F.lit(k).alias("d"))
        if k < depth:
            new = settled(new.dropDuplicates(["src", "dst"]).join(union_all(found).select("src", "dst"), ["src", "dst"], "left_anti"))
        found.append(new)
    # the last step's rows meet the others where a root's are numbered, and are never stored
    near = union_all(found).repartition("src").groupBy("src", "dst").agg(F.min("d").alias("d"))
    i = F.row_number().over(W.partitionBy("src").orderBy("d", "dst"))
    return near.select("src", "dst", "d", F.when(i > most, "capped").otherwise("captured").alias("status"))


@dataclass
class Limits:
    """How far a capture goes, and how much it takes."""

    depth: int = CLOSURE_DEPTH
    auxiliaries: int = AUXILIARIES
    nodes: int = ROOT_NODES
    equations: int = EQUATIONS
    supports: int = SUPPORTS
    support_nodes: int = SUPPORT_NODES


def capture(definitions: DataFrame, references: DataFrame, roots: DataFrame, equations: DataFrame, excluded: DataFrame, limits: Limits | None = None) -> DataFrame:
    """(key, role, reason): what a bounded capture takes, and what it refuses and why. One row a key; reason is null for what is taken.

    definitions (key, module, nodes of the signature, body_nodes of a body of one clause of variables, else null);
    references (src, dst); roots, equations (key); excluded (prefix) of modules. First the roots, then in waves what taken
    definitions refer to (auxiliaries, to limits.depth), then equations that are not taken yet (equation-signature), then the
    small abstractions that those mention (support). A wave that has no room for all takes the first by key. What is refused
    in one step may still be taken in a later one; else its last reason holds. Except for the roots and their references, all
    that is taken has a fixed bound, which is all that is ever sorted to find the first.
    """
    at = limits or Limits()
    prefixed = F.explode(F.concat(prefixes(F.split("module", r"\."), "."), F.array("module"))).alias("prefix")
    barred = definitions.select("key", prefixed).join(excluded.select("prefix").distinct(), "prefix", "left_semi").select("key").distinct().withColumn("barred", F.lit(True))
    known = settled(definitions.select("key", "nodes", "body_nodes").join(barred, "key", "left"))
    refs = settled(references.select("src", "dst").distinct())
    taken: list[DataFrame] = []
    refused: list[DataFrame] = []

    def judged(asked: DataFrame, role: str, limit: str, too_large: str, most: int | None) -> DataFrame:
        """Of keys not taken yet: those that this step takes; the others' reasons are noted."""
        new = asked.select("key").distinct()
        if taken:
            new = new.join(union_all(taken).select("key"), "key", "left_anti")
        why = F.when(F.col("nodes").isNull(), "unavailable-definition").when(F.col("barred"), "excluded-module").when(F.col("nodes") > at.nodes, too_large)
        new = settled(new.join(known, "key", "left").select("key", why.alias("reason")))
        good = new.where("reason is null").select("key")
        refused.append(new.where("reason is not null"))
        if most is not None:
            first = settled(good.orderBy("key").limit(most))
            refused.append(good.join(first, "key", "left_anti").select("key", F.lit(limit).alias("reason")))
            good = first
        taken.append(settled(good.select("key", F.lit(role).alias("role"))))
        return taken[-1]

    def mentioned(by: DataFrame) -> DataFrame:
        return refs.join(by.select(F.col("key").alias("src")), "src", "left_semi").select(F.col("dst").alias("key"))

    now, room = judged(roots, "selected-root", "", "signature-node-limit", None), at.auxiliaries
    for _ in range(at.depth):
        now = judged(mentioned(now), "auxiliary", "auxiliary-limit", "signature-node-limit", room)
        room -= now.count()  # of at most that many
    refused.append(mentioned(now).join(union_all(taken).select("key"), "key", "left_anti").select("key", F.lit("closure-depth").alias("reason")).distinct())
    proofs = judged(equations, "equation-signature", "equation-signature-limit", "equation-signature-node-limit", at.equations)
    small = known.where(F.col("body_nodes") <= at.support_nodes).select("key").join(equations.select("key"), "key", "left_anti")
    judged(mentioned(proofs).join(small, "key", "left_semi"), "support", "support-limit", "signature-node-limit", max(0, at.supports - (at.auxiliaries - room)))
    held = union_all(taken)
    last = union_all([r.withColumn("step", F.lit(k)) for k, r in enumerate(refused)]).join(held.select("key"), "key", "left_anti").groupBy("key").agg(F.max_by("reason", "step").alias("reason"))
    return held.select("key", "role", F.lit(None).cast("string").alias("reason")).unionByName(last.select("key", F.lit("omitted").alias("role"), "reason"))


def references_closed(references: DataFrame, roots: DataFrame) -> DataFrame:
    """(key) of the selected roots (key) and all that references (src, dst) lead to from any of them."""
    start = roots.select("key").distinct()
    return start.unionByName(closure(references, start.withColumnRenamed("key", "src")).select(F.col("dst").alias("key"))).distinct()


def omissions(reachable: DataFrame, available: DataFrame, refused: DataFrame) -> DataFrame:
    """(key, reason) of what is reachable (key) and not available (key): why it was refused (key, reason), or that nothing is known of it."""
    why = refused.groupBy("key").agg(F.min("reason").alias("reason"))
    return reachable.join(available.select("key"), "key", "left_anti").join(why, "key", "left").select("key", F.coalesce("reason", F.lit("unavailable-reference")).alias("reason"))


def coverage(selected: DataFrame, reachable: DataFrame, available: DataFrame, omitted: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: how many were selected, reachable, available and omitted, and the reasons of unsupported nodes, sorted."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    reasons = nodes.where("tag = 'unsupported'").agg(F.array_sort(F.collect_set("name")).alias("unsupported_reasons"))
    out = count(selected, "selected")
    for one in (count(reachable, "reachable"), count(available, "available"), count(omitted, "omitted"), reasons):
        out = out.crossJoin(one)  # one row each
    return out


def _walk(nodes: DataFrame, open_: Column) -> DataFrame:
    """(tree, node, path): nodes under the roots, by the numbers of the children taken; open_ says which children of which parents (ptag, ord) are gone to."""
    at = settled(nodes.select("tree", "node", "parent", "ord", "tag"))
    below = at.select("tree", F.col("node").alias("child"), F.col("parent").alias("node"), "ord")
    above = at.select("tree", "node", F.col("tag").alias("ptag"))
    steps = settled(below.join(above, NODE).where(open_).select("tree", "node", "child", "ord"))
    start = at.where("parent is null").select("tree", "node", F.array().cast("array<int>").alias("path"))
    return grow(start, lambda new: new.join(steps, NODE).select("tree", F.col("child").alias("node"), F.concat("path", F.array(F.col("ord").cast("int"))).alias("path")), NODE)


def neutral_occurrences(nodes: DataFrame) -> DataFrame:
    """(tree, node, path) of variables, definitions and what is applied to or projected from them; nothing below a binder."""
    spine = F.col("tag").isin("app", "proj")
    heads = nodes.where(~spine).select("tree", "node", F.col("tag").alias("head"))
    up = settled(nodes.where("ord = 0 and parent is not null").join(nodes.where(spine).select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", "node", "parent"))
    heads = grow(heads, lambda new: new.join(up, NODE).select("tree", F.col("parent").alias("node"), "head"), NODE)
    return _walk(nodes, F.col("ptag").isin("app", "proj", "con")).join(heads.where(F.col("head").isin("var", "def")), NODE).select("tree", "node", "path")


def retained_annotations(annotations: DataFrame, nodes: DataFrame) -> DataFrame:
    """annotations (tree, path, ...) whose path is in the emitted tree and leads into no binder's body."""
    body = (F.col("ptag") == "lam") | (F.col("ptag") == "pi") & (F.col("ord") == 1)
    return annotations.join(_walk(nodes, ~body).select("tree", "path"), ["tree", "path"], "left_semi")


def equation_signatures(nodes: DataFrame, equality: str) -> DataFrame:
    """(tree) of types that end in the equality: past types and the codomains of functions, then down the heads of applications. A tree is gone through in one task, a large one by rounds of joins."""
    small, large = by_size(nodes.select("tree", "node", "parent", "ord", "tag", "name"))

    def ends(node, parent, ord_, tag, name):
        below = {(p, o): k for k, (p, o) in enumerate(zip(parent, ord_, strict=True))}
        out = [False] * len(node)
        for k, p in enumerate(parent):
            if p is not None:
                continue
            applied = False
            while k is not None and tag[k] in ("type", "pi", "app") and not (applied and tag[k] != "app"):
                applied = applied or tag[k] == "app"
                k = below.get((node[k], 1 if tag[k] == "pi" else 0))
            if k is not None and tag[k] == "def":
                out[k] = name[k] == equality
        return (out,)

    found = folded(small, ["node", "parent", "ord", "tag", "name"], ends, "ends boolean").where("ends").select("tree")
    return (found if large is None else found.unionByName(_equations_by_rounds(large, equality))).distinct()


def _equations_by_rounds(nodes: DataFrame, equality: str) -> DataFrame:
    at = settled(nodes)
    child = at.select("tree", F.col("node").alias("next"), F.col("parent").alias("node"), F.col("ord").alias("k"), F.col("tag").alias("next_tag"))
    start = at.where("parent is null").select("tree", "node", "tag", F.lit(False).alias("applied"))
    outer = ~F.col("applied") & ((F.col("tag") == "type") & (F.col("k") == 0) | (F.col("tag") == "pi") & (F.col("k") == 1))
    head = (F.col("tag") == "app") & (F.col("k") == 0)
    step = lambda new: new.join(child, NODE).where(outer | head).select("tree", F.col("next").alias("node"), F.col("next_tag").alias("tag"), (F.col("applied") | (F.col("tag") == "app")).alias("applied"))
    ends = grow(start, step, NODE).where("tag = 'def'").select(*NODE)
    return ends.join(at.where(F.col("name") == equality).select(*NODE), NODE, "left_semi").select("tree").distinct()


def reindexed(nodes: DataFrame, owners: DataFrame) -> DataFrame:
    """(id, tree, node, parent_id): nodes of the selected owners (tree, place) numbered anew, in the owners' order and then their own."""
    kept = nodes.join(owners.select("tree", "place"), "tree").select("place", "tree", "node", "parent")
    ids = settled(indexed(kept, ["place", "tree", "node"], "id"))
    up = ids.select("tree", F.col("node").alias("parent"), F.col("id").alias("parent_id"))
    return ids.join(up, ["tree", "parent"], "left").select("id", "tree", "node", "parent_id")


def environment(interfaces: DataFrame, definitions: DataFrame, rewrites: DataFrame) -> DataFrame:
    """(kind, name, value): options and hashes of each module's interface (module, options, interface_hash, source_hash), rewrite names, and how keys are spelt."""
    each = F.explode(F.create_map(*[x for c in ("options", "interface_hash", "source_hash") for x in (F.lit(c), F.col(c).cast("string"))])).alias("kind", "value")
    out = interfaces.select(F.col("module").alias("name"), each).select("kind", "name", "value")
    out = out.unionByName(rewrites.select(F.lit("rewrite").alias("kind"), F.col("key").alias("name"), F.lit(None).cast("string").alias("value")).distinct())
    return out.unionByName(definitions.select(F.lit("spelling").alias("kind"), F.col("key").alias("name"), F.concat("module", F.lit("."), "short").alias("value")))


def builtins(rows: DataFrame) -> DataFrame:
    """(id, keys): all keys that any interface binds a builtin (id, key) to, sorted; conflicts stay."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_set("key")).alias("keys"))


def span_index(definitions: DataFrame, spans: DataFrame) -> DataFrame:
    """(file, spans) of files that have silent spans (file, lo, hi) and a definition."""
    have = definitions.select("file").distinct()
    return spans.join(have, "file", "left_semi").groupBy("file").agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("spans"))
