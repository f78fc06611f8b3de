"""Kept results of modules, so that what has not changed is not made again.

A store is a folder of two Parquet tables, rows and manifest, each with a partition for every module. The manifest says
what a module's rows were made from and how many they are. A fragment is used only if format, key version, options and
content agree and all its rows can be read; anything else is a miss.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.incremental import stale_fragments, usable_fragments
from weftgraph.schema import FRAGMENT_FORMAT, NODE_KEY_VERSION

MANIFEST = "slot string, module string, options_fp string, content_hash string, format int, key_version int, rows long"
SLOT = "slot"  # a digest, so that a folder's name is safe whatever the module's


def _replace(df: DataFrame, path: str) -> None:
    """Write df; of what is there, only the partitions that df has are replaced."""
    one_file = df.withColumn(SLOT, F.md5("module")).repartition(SLOT)
    one_file.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(SLOT).parquet(path)


def _exists(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return files, where, files.exists(where)


def keep(rows: DataFrame, sources: DataFrame, options_fp: str, path: str) -> None:
    """Store rows (module, ...) of the modules in sources (module, content_hash); one without rows is kept as empty.

    Rows are written before the manifest, and carry their content's hash: a run that stops between the two leaves misses.
    """
    made = rows.join(sources.select("module", "content_hash"), "module")
    _replace(made, f"{path}/rows")
    counts = made.groupBy("module").agg(F.count("*").alias("rows"))
    entries = sources.select("module", "content_hash").join(counts, "module", "left").select(
        "module",
        F.lit(options_fp).alias("options_fp"),
        "content_hash",
        F.lit(FRAGMENT_FORMAT).alias("format"),
        F.lit(NODE_KEY_VERSION).alias("key_version"),
        F.coalesce("rows", F.lit(0)).cast("long").alias("rows"),
    )
    _replace(entries, f"{path}/manifest")


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The store's manifest; empty where there is none."""
    if not _exists(spark, f"{path}/manifest")[2]:
        return spark.createDataFrame([], MANIFEST)
    return spark.read.schema(MANIFEST).option("ignoreCorruptFiles", "true").parquet(f"{path}/manifest")


def reuse(spark: SparkSession, path: str, schema: str, options_fp: str, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the modules whose fragments are good, the modules that have to be made); sources (module, content_hash) is what there is now.

    schema: the columns of rows beside module. Files that can't be read make their modules misses, as rows are counted.
    """
    sources = sources.select("module", "content_hash")
    listed = manifest(spark, path)
    good = usable_fragments(listed, options_fp, sources).join(listed.select("module", "content_hash", "rows"), "module")
    whole = f"{SLOT} string, module string, {schema}, content_hash string"
    if _exists(spark, f"{path}/rows")[2]:
        stored = spark.read.schema(whole).option("ignoreCorruptFiles", "true").parquet(f"{path}/rows")
    else:
        stored = spark.createDataFrame([], whole)
    found = stored.join(good.select("module", "content_hash"), ["module", "content_hash"], "left_semi")
    counts = found.groupBy("module").agg(F.count("*").alias("found"))
    hits = good.join(counts, "module", "left").where(F.coalesce("found", F.lit(0)) == F.col("rows")).select("module")
    return found.join(hits, "module", "left_semi").drop(SLOT, "content_hash"), sources.join(hits, "module", "left_anti").select("module")


def collect_garbage(spark: SparkSession, path: str, live: DataFrame) -> int:
    """Delete the fragments of modules that live (module) no longer has; how many. What can't be deleted stays for the next time."""
    gone = 0
    for r in stale_fragments(manifest(spark, path), live).select(F.md5("module").alias(SLOT)).distinct().toLocalIterator():
        for table in ("manifest", "rows"):  # without an entry a fragment is a miss, so the entry goes first
            files, where, there = _exists(spark, f"{path}/{table}/{SLOT}={r.slot}")
            if there and not files.delete(where, True):
                break
        else:
            gone += 1
    return gone
