"""Per-module and per-file summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.names import prefixes
from weftgraph.functions.text import indent


def state_counts(nodes: DataFrame, modules: DataFrame, failed: DataFrame) -> DataFrame:
    """(module, d, p, h, f) over nodes (module, state); a failed module adds one to f; modules without nodes have zeros."""
    each = [F.count_if(F.col("state") == s).alias(s.lower()) for s in "DPHF"]
    own = nodes.groupBy("module").agg(*each)
    bad = failed.select("module").distinct().withColumn("bad", F.lit(1))
    out = modules.select("module").distinct().join(own, "module", "left").join(bad, "module", "left").na.fill(0, ["d", "p", "h", "f", "bad"])
    return out.select("module", "d", "p", "h", (F.col("f") + F.col("bad")).alias("f"), F.col("bad").alias("failed"))


def externals_summary(definitions: DataFrame, external: DataFrame) -> DataFrame:
    """(module, postulates): each external module's distinct short names of postulates, sorted."""
    own = definitions.join(external, "module", "left_semi").where("state = 'P'").groupBy("module").agg(F.sort_array(F.collect_set("short")).alias("postulates"))
    return external.select("module").distinct().join(own, "module", "left").select("module", F.coalesce("postulates", F.array().cast("array<string>")).alias("postulates"))


def flag_rollup(flags: DataFrame) -> DataFrame:
    """(module, flags) sorted, of rows (module, flag); modules without flags have no row."""
    return flags.where("flag is not null").groupBy("module").agg(F.sort_array(F.collect_set("flag")).alias("flags"))


def unsolved_rollup(metas: DataFrame, constraints: DataFrame) -> DataFrame:
    """(module, meta_lines with repeats, constraint_lines distinct), each sorted; modules in neither have no row."""
    m = metas.groupBy("module").agg(F.sort_array(F.collect_list("line")).alias("meta_lines"))
    c = constraints.groupBy("module").agg(F.sort_array(F.collect_set("line")).alias("constraint_lines"))
    return m.join(c, "module", "full")


def merged_spans(spans: DataFrame) -> DataFrame:
    """Half-open spans (file, lo, hi) with those that overlap or touch joined."""
    order = W.partitionBy("file").orderBy("lo", "hi")
    reach = F.max("hi").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(F.col("lo") <= reach, 0).otherwise(1))
    island = F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("island", island).groupBy("file", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("file", "lo", "hi")


def in_spans(points: DataFrame, spans: DataFrame, closed: bool = False) -> DataFrame:
    """Points (file, at, ...) that lie in a span of their file; spans may overlap.

    Both are one sorted stream per file: a point is inside if the furthest end of the spans that began
    at or before it is beyond it. No pairs are made, so long files with many spans stay linear.
    """
    cols = [c for c in points.columns if c not in ("file", "at")]
    packed = points.select("file", "at", F.lit(1).alias("is_point"), F.lit(None).cast("long").alias("hi"), F.struct(*cols, F.lit(1).alias("__one")).alias("row"))
    ends = spans.select("file", F.col("lo").cast("long").alias("at"), F.lit(0).alias("is_point"), F.col("hi").cast("long").alias("hi"))
    both = packed.unionByName(ends, allowMissingColumns=True)
    reach = F.max("hi").over(W.partitionBy("file").orderBy("at", "is_point").rowsBetween(W.unboundedPreceding, 0))
    inside = (F.col("reach") >= F.col("at")) if closed else (F.col("reach") > F.col("at"))
    return both.withColumn("reach", reach).where((F.col("is_point") == 1) & F.coalesce(inside, F.lit(False))).select("file", "at", *[F.col(f"row.{c}") for c in cols])


def private_ranges(lines: DataFrame) -> DataFrame:
    """(file, lo, hi) of private blocks over lines (file, line_no, text).

    A block is a header line whose first word is private and the following lines that are blank or
    indented deeper. A header inside a block opens none of its own. Blocks that a deeper header would
    open inside an enclosing one are dropped by comparing with the furthest end so far.
    """
    w = lines.select("file", "line_no", indent(F.col("text")).alias("ind"), (F.trim("text") == "").alias("blank"), F.trim("text").rlike(r"^private(\s|$)").alias("head"))
    # the next line at each indentation or less: a stack of open blocks by indent, as at most a few distinct indents of headers exist
    heads = w.where("head").select("file", F.col("line_no").alias("lo"), F.col("ind").alias("k"))
    depths = heads.select("file", "k").distinct()
    ends = w.where("not blank").join(depths, "file").where("ind <= k").select("file", "k", "line_no")
    marks = ends.select("file", "k", "line_no", F.lit(None).cast("int").alias("lo")).unionByName(heads.select("file", "k", F.col("lo").alias("line_no"), "lo"))
    nxt = F.min(F.when(F.col("lo").isNull(), F.col("line_no"))).over(W.partitionBy("file", "k").orderBy("line_no").rangeBetween(1, W.unboundedFollowing))
    last = w.groupBy("file").agg(F.max("line_no").alias("last"))
    blocks = marks.withColumn("next", nxt).where("lo is not null").join(last, "file").select("file", "lo", F.coalesce(F.col("next") - 1, F.col("last")).alias("hi"))
    before = F.max("hi").over(W.partitionBy("file").orderBy("lo").rowsBetween(W.unboundedPreceding, -1))
    return blocks.withColumn("before", before).where("before is null or lo > before").select("file", "lo", "hi")


def module_sources(modules: DataFrame, owners: DataFrame, scanned: DataFrame, sites: DataFrame) -> DataFrame:
    """(module, file): the longest owning prefix's file, else the scan's, else the binding site's.

    owners (owner, file) are matched by a module's own prefixes, so the join stays an equi-join.
    """
    parts = F.split("module", r"\.")
    own = modules.select("module").distinct().withColumn("owner", F.explode(F.concat(prefixes(parts, "."), F.array("module"))))
    best = own.join(owners, "owner").groupBy("module").agg(F.max_by("file", F.struct(F.length("owner"), "file")).alias("f1"))
    scan = scanned.groupBy("module").agg(F.min("file").alias("f2"))
    site = sites.groupBy("module").agg(F.min("file").alias("f3"))
    return modules.select("module").distinct().join(best, "module", "left").join(scan, "module", "left").join(site, "module", "left").select("module", F.coalesce("f1", "f2", "f3").alias("file"))


def module_of_file(files: DataFrame) -> DataFrame:
    """(file, module) of files (file, module, place): where a file is listed again, its last place holds."""
    return files.groupBy("file").agg(F.max_by("module", "place").alias("module"))


def provider_groups(method_impl: DataFrame) -> DataFrame:
    return method_impl.groupBy("method_key").agg(F.sort_array(F.collect_set("binder_key")).alias("binders"))
