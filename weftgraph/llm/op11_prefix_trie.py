"""Prefix trie of conversations in preorder-interval encoding.

A node is a distinct sequence of first turns. A turn at its place is hashed to 128 bits, and the exclusive
or over a sequence's places names its node, so names are running totals and no sequence is compared as a
whole. Distinct sequences are ranked by the branches they take where the trie forks; a node's first and
last rank are an interval. Nodes sorted by first rank and depth are in preorder: a node's subtree goes
from its place to that of the last node with its last rank. What is summed over a subtree is the
difference of two prefix sums, which are made in ranges of the order, with only ranges' totals met in one task.

A conversation of any length, or a turn that any share of conversations begins with, is spread over
tasks: places are numbered by ranges, names run in blocks, and texts are read once and never shuffled
again after their hashes are known. Two different sequences get one name with a chance of 2**-128 a pair.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, mapped, stored, table

#: A rebuilt conversation begins with up to SHARED - 1 turns of the first conversation of its GROUP.
GROUP, SHARED = 5, 9
#: Turns of a block in which names run, and ids in a piece of a list.
BLOCK, PIECE = 4096, 65_536
#: Characters of a text that the bounds of ranges are made of.
BOUND_CHARS = 32
NODE = ["depth", "g1", "g2"]


def _xor(c: str) -> Column:
    return F.bit_xor(c)


def places(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, a, b, size) of turns (conv_id, turn, role, text): the place of each, from 1, by turn (null first), role and text; what hashes of role and text are, and the text's bytes in UTF-8.

    Null roles and texts are empty; turns alike in all of it are interchangeable. Rows are sorted in ranges over all
    conversations, so a conversation of any share of all rows is numbered by many tasks.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), text.alias("text"))
    dealt = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, BOUND_CHARS)).sortWithinPartitions("conv_id", "turn", "role", "text")
    hashed = dealt.select("conv_id", F.monotonically_increasing_id().alias("q"), F.xxhash64("role", "text").alias("a"), F.xxhash64(F.lit(11), "text", "role").alias("b"), F.octet_length("text").cast("long").alias("size"))
    sorted_ = stored(hashed.withColumn("part", F.shiftrightunsigned("q", 33)), "trie-turns")
    per = sorted_.groupBy("conv_id", "part").agg(F.min("q").alias("q0"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("conv_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    out = sorted_.join(per.select("conv_id", "part", "q0", before.alias("before")), ["conv_id", "part"])
    made = stored(out.select("conv_id", (F.col("q") - F.col("q0") + F.col("before") + 1).alias("pos"), "a", "b", "size"), "trie-places")
    discard(sorted_)
    return made


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations, their turns) of places: every conversation begins with the first h turns of the first one of its group, then come its own turns after its first h.

    h is the id's crc32 modulo SHARED; of a shorter first conversation all turns are taken, of an absent one none.
    Turns are (conv_id, depth, a, b, size); a conversation may be left without any.
    """
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % SHARED).cast("int")
    heads = own.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < SHARED)).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b", "size"))).alias("head"))
    convs = own.select("conv_id").distinct().withColumns({"base": base, "h": h}).join(heads, "base", "left")
    taken = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast("array<struct<pos:bigint,a:bigint,b:bigint,size:bigint>>"))
    convs = stored(convs.select("conv_id", "h", taken.alias("head")), "trie-convs")
    shared = convs.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.a", "t.b", "t.size")
    rest = own.join(convs.select("conv_id", "h", F.size("head").alias("m")), "conv_id").where("pos > h")
    return convs, shared.unionByName(rest.select("conv_id", (F.col("pos") - F.col("h") + F.col("m")).alias("depth"), "a", "b", "size"))


def named(turns: DataFrame) -> DataFrame:
    """turns (conv_id, depth, a, b, size) with the hashes (f1, f2) of each at its depth and the names (g1, g2) of the sequences up to it."""
    hashed = turns.select("conv_id", "depth", "size", F.xxhash64("depth", "a", "b").alias("f1"), F.xxhash64(F.lit(13), "depth", "b", "a").alias("f2"), F.floor(F.col("depth") / BLOCK).alias("block"))
    run = W.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    within = stored(hashed.withColumns({"g1": _xor("f1").over(run), "g2": _xor("f2").over(run)}), "trie-names")
    full = within.where(F.col("depth") % BLOCK == BLOCK - 1).select("conv_id", (F.col("block") + 1).alias("block"), "g1", "g2")
    if full.isEmpty():
        return within.drop("block")
    # names of long conversations: what all blocks before come to
    carry = full.withColumns({c: _xor(c).over(W.partitionBy("conv_id").orderBy("block")) for c in ("g1", "g2")}).select("conv_id", "block", F.col("g1").alias("c1"), F.col("g2").alias("c2"))
    both = within.join(carry, ["conv_id", "block"], "left")
    out = stored(both.withColumns({g: F.col(g).bitwiseXOR(F.coalesce(c, F.lit(0).cast("long"))) for g, c in (("g1", "c1"), ("g2", "c2"))}).drop("block", "c1", "c2"), "trie-names")
    discard(within)
    return out


def sorted_ids(df: DataFrame, order: list[str], out: str) -> DataFrame:
    """df with a number that grows in the given order, but with gaps; stored, so that it stays."""
    return stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(out, F.monotonically_increasing_id()), f"trie-{out}")


def prefix_sums(df: DataFrame, q: str, sums: dict[str, str]) -> DataFrame:
    """df with running totals (inclusive) of columns in the order of q, which sorted_ids made: within its ranges, then over the ranges' totals."""
    own = df.withColumn("__part", F.shiftrightunsigned(q, 33))
    ahead = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    totals = own.groupBy("__part").agg(*[F.sum(c).alias(f"__{c}") for c in sums])
    starts = totals.select("__part", *[F.coalesce(F.sum(f"__{c}").over(ahead), F.lit(0)).alias(f"__{c}") for c in sums])  # a row for each range
    run = W.partitionBy("__part").orderBy(q).rowsBetween(W.unboundedPreceding, 0)
    within = own.withColumns({name: F.sum(c).over(run) for c, name in sums.items()})
    return within.join(starts, "__part").withColumns({name: (F.col(name) + F.col(f"__{c}")).cast("long") for c, name in sums.items()}).drop("__part", *[f"__{c}" for c in sums])


def _digested(batches: Iterator) -> Iterator:
    """(node, sha256) of pieces that come sorted by node and place: one running digest, so a list is never held."""
    last, running = None, None
    for batch in batches:
        keys = list(zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True))
        done: list[tuple] = []
        for key, piece in zip(keys, batch.column(3).to_pylist(), strict=True):
            if key != last:
                if running:
                    done.append((*last, running.hexdigest()))
                last, running = key, hashlib.sha256()
            else:
                running.update(b",")
            running.update(piece.encode())
        yield _digests(done)
    if running:
        yield _digests([(*last, running.hexdigest())])


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[*NODE, "ends_sha256"])


def id_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256): the digest of the ids of each node's ends (conv_id, node), ascending and with commas between.

    Ids travel in pieces of text of bounded size, so that many ends of a node are a few rows; a task reads them in order.
    """
    order = [*NODE, "conv_id"]
    dealt = ends.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("q", F.monotonically_increasing_id())
    pieces = dealt.groupBy(*NODE, F.floor(F.col("q") / PIECE).alias("piece")).agg(F.array_join(F.array_sort(F.collect_list("conv_id")), ",").alias("ids"))
    return mapped(pieces.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids"), _digested, "depth long, g1 long, g2 long, ends_sha256 string")


def trie(conversations: DataFrame) -> DataFrame:
    """Per node of the trie of rebuilt conversations: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and first and last, its interval of places in preorder.

    conversations: (conv_id, turn, role, text, ...). Null roles and texts are empty; rows without a conv_id belong to no
    conversation and are left out; repeated rows are turns of their own. The root (depth 0, no parent) is there if there is
    any conversation; without one there are no rows. Other columns are not read.
    """
    own = places(conversations.select("conv_id", "turn", "role", "text"))
    convs, turns = rebuilt(own)
    w = named(turns)
    zero = F.lit(0).cast("long")
    # names of nodes and of their parents, how many go through each, and the bytes that each would save
    grown = w.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("size").alias("size"), F.max(F.col("g1").bitwiseXOR(F.col("f1"))).alias("p1"), F.max(F.col("g2").bitwiseXOR(F.col("f2"))).alias("p2"))
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), "n_convs", "conv_id", zero.alias("size"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"))
    nodes = stored(grown.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("p1").alias("g1"), F.col("p2").alias("g2")).agg(F.count("*").alias("n_children"))
    parents = stored(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", zero)), "trie-parents")
    up = parents.select((F.col("depth") + 1).alias("depth"), F.col("g1").alias("p1"), F.col("g2").alias("p2"), F.col("conv_id").alias("parent_conv_id"), (F.col("n_children") > 1).alias("fork"))
    known = stored(parents.join(up, ["depth", "p1", "p2"], "left").drop("p1", "p2"), "trie-known")
    # where conversations end; of equal sequences one stands for all
    last = w.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("end"))
    ends = stored(convs.select("conv_id").join(last, "conv_id", "left").select("conv_id", *[F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in NODE]), "trie-ends")
    distinct = stored(ends.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id")), "trie-distinct")
    steps = stored(w.select("conv_id", *NODE, "f1", "f2").join(distinct.select("conv_id"), "conv_id", "left_semi"), "trie-steps")
    # ranks of distinct sequences by their branches; one that is another's beginning goes before it, as it is shorter
    taken = steps.join(known.where("fork").select(*NODE), NODE, "left_semi")
    branches = taken.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("depth", "f1", "f2"))), lambda s: F.struct(s["f1"], s["f2"])).alias("branches"))
    ranked = distinct.join(branches, "conv_id", "left").select("conv_id", "depth", F.coalesce("branches", F.array().cast("array<struct<f1:bigint,f2:bigint>>")).alias("branches"))
    ranks_at = sorted_ids(ranked, ["branches", "depth"], "rank")
    ranks = ranks_at.select("conv_id", "rank")
    bounds = [F.min("rank").alias("first_rank"), F.max("rank").alias("last_rank")]
    spans = steps.join(ranks, "conv_id").groupBy(*NODE).agg(*bounds).unionByName(ranks.agg(*bounds).where("first_rank is not null").select(zero.alias("depth"), zero.alias("g1"), zero.alias("g2"), "first_rank", "last_rank"))
    saved = (F.col("n_convs") - 1) * F.col("size")
    order = sorted_ids(known.join(spans, NODE).withColumns({"one": F.lit(1).cast("long"), "leaf": (F.col("n_children") == 0).cast("long"), "own_saved": saved}), ["first_rank", "depth"], "order")
    run = stored(prefix_sums(order, "order", {"one": "first", "leaf": "leaves_to", "own_saved": "saved_to"}), "trie-run")
    discard(own, w, nodes, parents, known, distinct, steps, ranks_at, order)
    # the last node of each rank ends the subtrees of all nodes whose last rank it is
    stops = run.groupBy(F.col("first_rank").alias("last_rank")).agg(F.max("first").alias("last"), F.max("leaves_to").alias("leaves_last"), F.max("saved_to").alias("saved_last"))
    digests = id_digests(ends)
    out = run.join(stops, "last_rank").join(digests, NODE, "left")
    return out.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        (F.col("leaves_last") - F.col("leaves_to") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_last") - F.col("saved_to") + F.col("own_saved")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
        (F.col("first") - 1).alias("first"),
        (F.col("last") - 1).alias("last"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations")).drop("first", "last")


#: crc32 bit by bit; nodes by the list of their turns' digests; subtrees by all prefixes of each node.
SQL = r"""
with o as materialized (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as pos from conversations where conv_id is not null),
t as materialized (select c, list(md5(length(role) || ':' || role || text) order by pos) as d, list(strlen(text) order by pos) as z from o group by c),
ops as (select c, flatten(list_transform(string_split(c::varchar, ''), lambda x: [ascii(x)::bigint, -1, -1, -1, -1, -1, -1, -1, -1])) as ops from t),
h as materialized (select c, (xor(list_reduce(list_prepend(4294967295::bigint, ops), lambda a, x: case when x >= 0 then xor(a, x) else xor(a >> 1, 3988292384::bigint * (a & 1)) end), 4294967295::bigint) % 9)::bigint as h from ops),
r as materialized (select t.c, list_concat(coalesce(b.d[1:h.h], []), t.d[h.h + 1:]) as d, list_concat(coalesce(b.z[1:h.h], []), t.z[h.h + 1:]) as z from t join h on h.c = t.c left join t b on b.c = t.c - t.c % 5),
m as materialized (select c, k, d[1:k] as p, case when k = 0 then 0 else z[k] end as size, len(d) = k as ends from r, unnest(range(0, len(d) + 1)) x(k)),
n as materialized (select p, any_value(k) as depth, min(c) as conv_id, count(*) as n_convs, max(size) as size, coalesce(string_agg(c::varchar, ',' order by c) filter (ends), '') as ids from m group by p),
kids as (select p[1:len(p) - 1] as p, count(*) as n_children from n where depth > 0 group by 1),
own as materialized (select n.*, coalesce(n_children, 0) as n_children from n left join kids on kids.p = n.p),
sub as (select own.p[1:k] as p, count(*) filter (n_children = 0) as n_leaves, sum((n_convs - 1) * size)::bigint as saved_tokens from own, unnest(range(0, depth + 1)) x(k) group by 1)
select own.conv_id, own.depth::bigint as depth, up.conv_id as parent_conv_id, own.n_convs, own.n_children::bigint as n_children, n_leaves, saved_tokens, sha256(own.ids) as ends_sha256
from own join sub on sub.p = own.p left join own up on own.depth > 0 and up.p = own.p[1:len(own.p) - 1]
"""
