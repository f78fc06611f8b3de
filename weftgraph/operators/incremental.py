"""Reuse of what has not changed: epochs of modules, manifests, placeholders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import FRAGMENT_FORMAT, NODE_KEY_VERSION


def epochs(definitions: DataFrame) -> DataFrame:
    """(module, epoch): a digest of a module's definitions in key order."""
    rows = F.transform(F.array_sort(F.collect_list(F.struct("key", "state"))), lambda r: F.concat(r["key"], r["state"]))
    return definitions.groupBy("module").agg(F.md5(F.array_join(rows, ",")).alias("epoch"))


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """(module, status): added, removed, changed or same."""
    both = now.join(before.select("module", F.col("epoch").alias("old")), "module", "full")
    return both.select("module", F.when(F.col("old").isNull(), "added").when(F.col("epoch").isNull(), "removed").when(F.col("epoch") != F.col("old"), "changed").otherwise("same").alias("status"))


def usable_fragments(manifest: DataFrame, options_fp: str, hashes: DataFrame) -> DataFrame:
    """Modules of a manifest whose fragment is still good: format, options and content agree; anything else is a miss."""
    good = manifest.where((F.col("format") == FRAGMENT_FORMAT) & (F.col("key_version") == NODE_KEY_VERSION) & (F.col("options_fp") == options_fp))
    return good.join(hashes, ["module", "content_hash"], "left_semi").select("module")


def cacheable(modules: DataFrame) -> DataFrame:
    """Modules (module, is_main, fresh, definitions) whose fragment may be kept: imported ones always, the main one only if freshly checked or without definitions."""
    return modules.where(~F.col("is_main") | F.col("fresh") | (F.col("definitions") == 0)).select("module")


def grown(after: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that a growing table has gained since a snapshot of it: those whose keys are new."""
    return after.join(before.select(*keys).distinct(), keys, "left_anti")


def list_ends(lists: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what growing lists (key, pos, value) have gained, in their own places; the new marks (key, length)), places from 0.

    A mark says how far a list was read; only its later places are, so repeated values and their order stay, and a list
    that hasn't grown gives nothing. A list shorter than its mark was begun anew, and is read as a whole.
    """
    lengths = lists.groupBy("key").agg((F.max("pos") + 1).cast("long").alias("length"))
    from_ = lengths.join(marks.groupBy("key").agg(F.max("length").alias("mark")), "key", "left").select("key", "length", F.when(F.col("length") < F.col("mark"), 0).otherwise(F.coalesce("mark", F.lit(0))).cast("long").alias("mark"))
    new = lists.join(from_.where("length > mark").select("key", "mark"), "key").where(F.col("pos") >= F.col("mark")).select("key", "pos", "value")
    kept = marks.join(lengths.select("key"), "key", "left_anti").select("key", F.col("length").cast("long").alias("length"))
    return new, from_.select("key", "length").unionByName(kept)


def stale_fragments(manifest: DataFrame, live: DataFrame) -> DataFrame:
    """Modules with a fragment but no source any more."""
    return manifest.join(live.select("module"), "module", "left_anti").select("module")


def placeholders(modules: DataFrame, detailed: DataFrame, failed: DataFrame, external: DataFrame) -> DataFrame:
    """(module, reason) of modules without details: failed before external before filtered."""
    flag = lambda df, n: df.select("module").distinct().withColumn(n, F.lit(True))
    rest = modules.select("module").distinct().join(detailed, "module", "left_anti")
    return rest.join(flag(failed, "f"), "module", "left").join(flag(external, "e"), "module", "left").select("module", F.when(F.col("f"), "failed").when(F.col("e"), "external").otherwise("filtered").alias("reason"))
