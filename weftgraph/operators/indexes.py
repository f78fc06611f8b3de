"""Dense indices, CSR, trees of names, search postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.names import bigrams, levenshtein_budget, prefixes
from weftgraph.operators.fixpoint import settled
from weftgraph.schema import PROV_CODES, code


def indexed(df: DataFrame, order: list[str], out: str = "idx") -> DataFrame:
    """df with the place of each row in a total order, from 0.

    Rows are sorted in ranges; a range's places begin after the rows of those before, so no task sorts
    the whole table. What is sent to all tasks is a row for each range.
    """
    dealt = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__q", F.monotonically_increasing_id()))
    dealt = dealt.withColumn("__part", F.shiftrightunsigned("__q", 33))
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__part", before.alias("__before"))
    within = F.col("__q").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.join(F.broadcast(starts), "__part").withColumn(out, F.col("__before") + within).drop("__part", "__q", "__before")


def csr_offsets(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(idx, offset): where each node's targets begin; one row more than nodes, the last with their total. Repeated edges count once."""
    degree = edges.select("src", "dst").distinct().groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("n"))
    every = nodes.select("idx").join(degree, "idx", "left").select("idx", F.coalesce("n", F.lit(0)).alias("n"))
    last = every.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("idx"), F.lit(0).cast("long").alias("n"))
    return running_total(every.unionByName(last), "idx", "n").select("idx", F.col("before").alias("offset"))


def running_total(df: DataFrame, place: str, n: str, block: int = 1 << 16) -> DataFrame:
    """df with before: the sum of n over smaller places. Blocks of places are summed apart; only their totals meet in one task."""
    cut = df.withColumn("__block", F.floor(F.col(place) / block))
    within = F.sum(n).over(W.partitionBy("__block").orderBy(place).rowsBetween(W.unboundedPreceding, -1))
    totals = cut.groupBy("__block").agg(F.sum(n).alias("__sum"))
    ahead = F.sum("__sum").over(W.orderBy("__block").rowsBetween(W.unboundedPreceding, -1))
    starts = totals.select("__block", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    total = (F.col("__ahead") + F.coalesce(F.col("__within"), F.lit(0))).cast("long")
    return cut.withColumn("__within", within).join(starts, "__block").withColumn("before", total).drop("__block", "__within", "__ahead")


def csr_targets(edges: DataFrame) -> DataFrame:
    """(place, src, dst, prov): targets in the order of sources, then targets, with the code of each edge's provenance."""
    once = settled(edges.groupBy("src", "dst").agg(F.min("prov").alias("prov")))  # numbering reads it twice
    return indexed(once, ["src", "dst"], "place").select("place", "src", "dst", code(F.col("prov"), PROV_CODES, PROV_CODES["unknown"]).alias("prov"))


def name_tree(names: DataFrame, sep: str, pattern: str) -> DataFrame:
    """(path, idx, parent, is_name) of names (name) and all their proper prefixes, in order of segments; -1 above roots."""
    parts = F.split("name", pattern)
    own = names.select("name").distinct()
    all_ = own.select(F.col("name").alias("path"), F.lit(True).alias("is_name")).unionByName(own.select(F.explode(prefixes(parts, sep)).alias("path"), F.lit(False).alias("is_name")))
    nodes = all_.groupBy("path").agg(F.bool_or("is_name").alias("is_name")).withColumn("segments", F.split("path", pattern))
    numbered = indexed(nodes, ["segments"])
    above = numbered.select(F.col("path").alias("up"), F.col("idx").alias("parent"))
    up = F.when(F.size("segments") > 1, F.array_join(F.slice("segments", 1, F.size("segments") - 1), sep))
    return numbered.withColumn("up", up).join(above, "up", "left").select("path", "idx", F.coalesce("parent", F.lit(-1)).alias("parent"), "is_name")


def search_postings(names: DataFrame, most: int | None = None) -> DataFrame:
    """(bigram, ids) over names (id, name), lower-cased; empty above most names, where no index is built."""
    if most is not None and names.limit(most + 1).count() > most:
        names = names.limit(0)
    grams = names.select("id", F.explode(bigrams(F.lower("name"))).alias("bigram"))
    return grams.groupBy("bigram").agg(F.sort_array(F.collect_set("id")).alias("ids"))


def posting_blocks(modules: DataFrame, definitions: DataFrame, block: int = 1 << 12, most: int | None = None) -> DataFrame:
    """(bigram, block, n, first, deltas) over modules and definitions (id, name), lower-cased; empty above most names, where no index is built.

    Modules keep their ids and definitions' follow them. Ids of a bigram are cut by ranges of block ids, so a bigram that
    every name has is many rows; a row has the first id and the steps from each to the next.
    """
    after = F.coalesce(F.max("id") + 1, F.lit(0)).cast("long").alias("after")
    shift = modules.agg(after)  # one row
    names = modules.select(F.col("id").cast("long").alias("id"), "name").unionByName(definitions.crossJoin(F.broadcast(shift)).select((F.col("id") + F.col("after")).alias("id"), "name"))
    if most is not None and names.limit(most + 1).count() > most:
        names = names.limit(0)
    grams = names.select("id", F.floor(F.col("id") / block).alias("block"), F.explode(bigrams(F.lower("name"))).alias("bigram"))
    rows = grams.groupBy("bigram", "block").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    steps = F.zip_with(F.slice("ids", 2, F.size("ids")), F.slice("ids", 1, F.size("ids") - 1), lambda b, a: (b - a).cast("int"))
    return rows.select("bigram", "block", F.size("ids").cast("long").alias("n"), F.get("ids", F.lit(0)).alias("first"), steps.alias("deltas"))


def found_names(blocks: DataFrame, asked: DataFrame) -> DataFrame:
    """(text, id) of the names that have all bigrams of each asked text (of two characters or more): candidates, to be compared with the text itself.

    A text's bigrams meet within blocks; a block that lacks one of them is not opened.
    """
    wanted = asked.select("text").distinct().select("text", bigrams(F.lower("text")).alias("grams"))
    rows = wanted.select("text", F.size("grams").alias("k"), F.explode("grams").alias("bigram")).join(blocks, "bigram")
    whole = rows.groupBy("text", "block").agg(F.count("*").alias("here"), F.max("k").alias("k")).where("here = k").select("text", "block")
    start = F.struct(F.col("first").alias("last"), F.array("first").alias("ids"))
    running = F.aggregate("deltas", start, lambda a, d: F.struct((a["last"] + d).alias("last"), F.array_append(a["ids"], a["last"] + d).alias("ids")), lambda a: a["ids"])
    ids = rows.join(whole, ["text", "block"], "left_semi").select("text", "k", F.explode(running).alias("id"))
    return ids.groupBy("text", "id").agg(F.count("*").alias("here"), F.max("k").alias("k")).where("here = k").select("text", "id")


def nearest_keys(asked: DataFrame, known: DataFrame) -> DataFrame:
    """For each asked (name) the known key at the smallest edit distance within its budget, of equals the first.

    Names meet the keys whose lengths are within the budget, by an equi-join on each of these lengths.
    """
    budget = levenshtein_budget(F.col("name"))
    sized = asked.select("name").distinct().withColumn("n", F.explode(F.sequence(F.length("name") - budget, F.length("name") + budget)))
    pairs = sized.join(known.select("key", F.length("key").alias("n")).distinct(), "n")
    near = pairs.withColumn("d", F.levenshtein("name", "key")).where(F.col("d") <= budget)
    return near.groupBy("name").agg(F.min(F.struct("d", "key")).alias("best")).select("name", F.col("best.key").alias("key"), F.col("best.d").alias("d"))


def little_endian(values: Column, width: int = 4) -> Column:
    """Base64 of an array of whole numbers, each in width bytes, lowest first."""
    one = lambda v: F.concat(*[F.lpad(F.hex(F.shiftrightunsigned(v.cast("long"), 8 * k).bitwiseAND(255)), 2, "0") for k in range(width)])
    return F.base64(F.unhex(F.array_join(F.transform(values, one), "")))
