"""The module graph of source folders alone: no definitions, only modules and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.names import SOURCE_SUFFIXES
from weftgraph.operators import fixpoint
from weftgraph.plans.pipeline import Facts, Graph, assemble
from weftgraph.sinks import fragments
from weftgraph.sources import scan

DEFINITIONS = "key string, module string, short string, state string, kind string, file string, line long, ignorable boolean, where_helper boolean, arity long, unsafe array<string>"


#: What a scan of one file gives, and is kept as: the name of its module, if it has a header, and an import a row (or none).
SCANNED = "name string, dst string"


def scanned_headers(files: DataFrame) -> DataFrame:
    """(module, name, dst): what each file (as module) declares; a row for each import, or one without."""
    found = scan.headers(scan.source_lines(files))
    return found.select(F.col("file").alias("module"), F.col("module").alias("name"), F.explode_outer("imports").alias("dst"))


def reused_headers(files: DataFrame, cache: str) -> DataFrame:
    """scanned_headers, of which those of files with the same content as in an earlier run come from the folder cache; what was scanned anew is kept there, and what has no file any more is deleted."""
    spark = files.sparkSession
    sources = fixpoint.settled(files.select(F.col("file").alias("module"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash")))
    old, fresh = fragments.reuse(spark, cache, SCANNED, "scan", sources)
    old, fresh = fixpoint.settled(old.select("module", "name", "dst")), fixpoint.settled(fresh)
    made = fixpoint.settled(scanned_headers(files.join(fresh.select(F.col("module").alias("file")), "file", "left_semi")))
    if not fresh.isEmpty():
        fragments.keep(made, sources.join(fresh, "module", "left_semi"), "scan", cache)
    fragments.collect_garbage(spark, cache, sources)
    return old.unionByName(made)


def facts_of_sources(spark: SparkSession, files: DataFrame, entry: str | None = None, exclude: tuple[str, ...] = (), cache: str | None = None) -> Facts:
    """files (file, text) -> facts; entry is a file. With cache, only files that have changed since the last run are scanned."""
    empty = lambda s: spark.createDataFrame([], s)
    found = fixpoint.settled(scanned_headers(files) if cache is None else reused_headers(files, cache))
    modules = found.groupBy(F.col("name").alias("module")).agg(F.min("module").alias("file"))
    imports = found.where("dst is not null and name != dst").select(F.col("name").alias("src"), "dst").distinct()
    start = found.where(F.col("module") == entry).groupBy("module").agg(F.max("name").alias("name")).select(F.col("name").alias("module")) if entry else empty("module string")
    return Facts(
        definitions=empty(DEFINITIONS),
        edges=empty("src string, dst string, prov string"),
        imports=imports,
        method_impl=empty("method_key string, binder_key string"),
        applications=empty("src string, dst string, applied long"),
        module_files=modules,
        private_ranges=empty("file string, lo long, hi long"),
        entry=start,
        failed=empty("module string, reason string"),
        excludes=spark.createDataFrame([(x,) for x in exclude], "prefix string"),
        flags=empty("module string, flag string"),
        source_files=files.select("file"),
    )


def entry_and_roots(paths: list[str]) -> tuple[str | None, list[str]]:
    """(the entry file or None, the folders to scan) of the paths of a command line: a source file is the entry, the first of several, and its folder a root."""
    entry, roots = None, []
    for p in paths:
        folder, name = p.rpartition("/")[::2]
        if name.endswith(SOURCE_SUFFIXES):
            entry, p = entry or p.removeprefix("file://"), folder or "."
        if p not in roots:
            roots.append(p)
    if entry and "/" not in entry:
        entry = f"./{entry}"
    return entry, roots


def scanned_graph(spark: SparkSession, roots: list[str], exclude: tuple[str, ...] = (), no_externals: bool = False, entry: str | None = None, cache: str | None = None) -> Graph:
    files = scan.source_files(spark, roots)
    files = files if cache is None else fixpoint.settled(files)
    root = roots[0].removeprefix("file://").rstrip("/")
    return assemble(facts_of_sources(spark, files, entry, exclude, cache), root, no_externals)
