"""Mixing sources to target weights by the cube method.

A source's target over its size gives how often each of its documents is taken on average: whole
times for all, and once more for a part. That part is a balanced sample: inclusion probabilities
move along directions that keep the sums of words and of documents, until each is 0 or 1. This
flight runs in blocks of some thousand documents of one source; each block leaves two fractional
documents at most, which meet in blocks of the next round, until one block a source is left. Its
last dozen are rounded to the nearest total of words by trying all ways (the landing). So a source's
words come near its target however many blocks it has, and no block grows with the data.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.common import free_names, prepare, stored, table

WORDS = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2.0
#: Documents in a block of the flight.
BLOCK = 2048
NEAR = 1e-9
#: Fractional documents of a source's last block that are left to the landing.
LEFT = 12


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sizes (source, source_size) with target: by weight, but none above most times its size, what is over dealt anew by weight.

    Sources are few against documents; the three windows sort them as one list. Those with the smallest
    size by weight fill first, so the source at which the rest no longer does gives everyone's level.
    """
    kinds = len(weights)
    order = F.row_number().over(W.orderBy(F.col("source").cast("binary").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("nth") % kinds + 1).cast("int"))
    ranked = sizes.withColumn("nth", order).withColumn("weight", w).withColumn("most", F.col("source_size") * most)
    fill = W.orderBy(F.col("most") / F.col("weight"), "nth")
    every = W.partitionBy(F.lit(0))
    ranked = ranked.withColumns(
        {
            "filled": F.coalesce(F.sum("most").over(fill.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "open": F.sum("weight").over(fill.rowsBetween(0, W.unboundedFollowing)),
            "all_words": F.sum("source_size").over(every) * share,
        }
    )
    # the level if just this source and later ones were open: it rises while they fill and falls after that
    level = (F.col("all_words") - F.col("filled")) / F.col("open")
    ranked = ranked.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least(F.col("most"), F.col("level") * F.col("weight"))
    return ranked.select("source", "source_size", target.cast("double").alias("target"))


def flight(p: np.ndarray, x: np.ndarray, seed: int, leave: int = 0) -> np.ndarray:
    """Move probabilities p until columns of x allow no further move, or leave are fractional; sums of x * p stay.

    x: documents x balancing variables (each divided by nothing: all documents of a call had the same
    probability at first, so balance of x/p0 is balance of x). At most as many stay fractional as x has
    columns. Windows of one more than that many documents suffice, and a seed makes reruns agree.
    """
    p, r = p.copy(), np.random.default_rng(seed)
    m = x.shape[1] + 1
    free = [int(i) for i in np.flatnonzero((p > NEAR) & (p < 1 - NEAR))]
    r.shuffle(free)
    draws = r.random(len(free) + 1)
    held: list[int] = []
    for k in range(len(free) + 1):
        if len(held) + len(free) <= leave:
            break
        while len(held) < m and free:
            held.append(free.pop())
        if len(held) < 2:
            break
        direction = null_direction(x[held])
        if direction is None:
            if not free:
                break
            continue
        q = p[held]
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(direction > 0, (1 - q) / direction, np.where(direction < 0, -q / direction, np.inf)).min()
            down = np.where(direction > 0, q / direction, np.where(direction < 0, (q - 1) / direction, np.inf)).min()
        step = up if draws[k] * (up + down) < down else -down
        q = q + step * direction
        q[q < NEAR] = 0
        q[q > 1 - NEAR] = 1
        p[held] = q
        held = [i for i in held if 0 < p[i] < 1]
    return p


def null_direction(x: np.ndarray) -> np.ndarray | None:
    """A vector u with u @ x = 0 that isn't 0, or None; in closed form for three documents and two variables."""
    if x.shape == (3, 2):
        u = np.cross(x[:, 0], x[:, 1])
        if np.abs(u).max() > NEAR * max(1.0, np.abs(x).max()):
            return u / np.abs(u).max()
    _, s, v = np.linalg.svd(x.T)
    rank = int((s > NEAR * max(1.0, s[0] if len(s) else 0)).sum())
    return v[rank] if rank < len(x) else None


def landing(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few fractional ones to the total of words nearest to theirs; of equals to the nearest number of documents, then the first.

    All ways to round them are gone through, so these are a dozen at most; they are of all sizes, so some way is mostly within a few words.
    """
    open_ = np.flatnonzero((p > 0) & (p < 1))
    ways = np.arange(1 << len(open_))[:, None] >> np.arange(len(open_)) & 1
    words, number = np.abs((ways - p[open_]) @ size[open_]), np.abs((ways - p[open_]).sum(axis=1))
    p = p.copy()
    p[open_] = ways[np.lexsort((number.round(6), words.round(3)))[0]]
    return p


def _fly(key: tuple, rows: pa.Table) -> pa.Table:
    """The flight of one block; the last block of a source lands. Ids stay in Arrow: as numbers of pandas, long ones beside a null would be rounded."""
    rows = rows.take(pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in ("h", "nth", "doc_id", "size")]))
    seed = int(np.bitwise_xor.reduce(rows["h"].to_numpy().astype(np.int64).view(np.uint64), initial=np.uint64(len(rows))))
    size = rows["size"].to_numpy().astype(np.float64)
    last = bool((rows["blocks"].to_numpy() == 1).all())
    p = flight(rows["p"].to_numpy().astype(np.float64), np.stack([size / max(size.max(), 1.0), np.ones(len(size))], axis=1), seed, LEFT if last else 0)
    return rows.set_column(rows.schema.get_field_index("p"), "p", pa.array(landing(p, size) if last else p, pa.float64()))


def mixed(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """Per document: size (words), source_size, target of its source, times (how often the mix takes it) and taken words.

    Null and empty texts have size 0; they are taken like others and add no words. Null sources are one
    source, the last. Repeated rows count as documents of their own. An empty table gives no rows.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")
    prepare(docs.sparkSession)
    # h also tells repeated ids apart; rows equal in all of it are interchangeable, counted and numbered, so that blocks tell them apart
    base = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), F.xxhash64(F.col(key), F.col(text), F.lit(4)).alias("h"))
    base = base.groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("rows"))
    base = stored(base.select("doc_id", "source", "size", "h", F.explode(F.sequence(F.lit(1).cast("long"), F.col("rows"))).alias("nth")), "mix-sizes")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    goal = targets(sums.select("source", "source_size")).alias("g")
    per_source = sums.alias("s").join(goal, F.col("s.source").eqNullSafe(F.col("g.source"))).select("s.source", "s.source_size", "g.target", F.expr("cast(ceil(s.n / %d) as long)" % BLOCK).alias("blocks"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(MOST), F.col("target") / F.col("source_size"))).otherwise(F.lit(1.0))
    # many rows of one source meet their one row here: salted, so that a large source is dealt to all tasks
    salts = 64
    spread = per_source.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("t")
    rows = base.withColumn("salt", F.pmod(F.xxhash64("h", "nth"), F.lit(salts)).cast("int")).alias("b")
    rows = rows.join(spread, F.col("b.source").eqNullSafe(F.col("t.source")) & (F.col("b.salt") == F.col("t.salt")))
    rows = rows.select("b.doc_id", "b.source", "b.size", "b.h", "b.nth", "t.source_size", "t.target", "t.blocks", rate.alias("rate"))
    rows = rows.withColumns({"block": F.pmod(F.xxhash64("h", "nth", F.lit(1)), "blocks"), "whole": F.floor(F.col("rate") + NEAR).cast("long")})
    rows = rows.withColumn("p", F.greatest(F.lit(0.0), F.col("rate") - F.col("whole"))).drop("rate")
    schema = rows.schema
    done, level = [rows.where("p = 0")], 0
    now = stored(rows.where("p > 0").groupBy("source", "block").applyInArrow(_fly, schema), "mix-flight-0")
    while True:
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done.append(now.where(~open_))
        rest = now.where(open_)
        if rest.isEmpty():
            break
        level += 1
        # two of each block at most are left: as many blocks meet as fill one again
        fewer = rest.withColumns({"blocks": F.ceil(F.col("blocks") / (BLOCK // 2)), "block": F.floor(F.col("block") / (BLOCK // 2))})
        now = stored(fewer.groupBy("source", "block").applyInArrow(_fly, schema), f"mix-flight-{level}")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    times = F.col("whole") + F.round("p").cast("long")
    return out.select("doc_id", "source", "size", "source_size", "target", times.alias("times"), (times * F.col("size")).alias("taken"), "h")


def mix(docs: DataFrame) -> DataFrame:
    """docs as the mix takes them: documents left out are gone, those taken twice come twice. All columns stay, whatever their names."""
    id_, h, times, nth, own_h, own_nth, copy = free_names(docs, "id", "h", "times", "nth", "own_h", "own_nth", "copy")
    plan = stored(mixed(docs), "mix-plan").select(F.col("doc_id").alias(id_), F.col("h").alias(h), F.col("times").alias(times))
    own = docs.withColumn(own_h, F.xxhash64(F.col("doc_id"), F.col("text"), F.lit(4)))
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(own_h) == F.col(h))
    # rows alike in id and text are interchangeable: numbered on both sides, where there are any
    if not plan.groupBy(id_, h).count().where("count > 1").isEmpty():
        plan = plan.withColumn(nth, F.row_number().over(W.partitionBy(id_, h).orderBy(F.desc(times))))
        own = own.withColumn(own_nth, F.row_number().over(W.partitionBy("doc_id", own_h).orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))))
        same = same & (F.col(own_nth) == F.col(nth))
    both = own.join(plan.where(F.col(times) > 0), same)
    return both.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
