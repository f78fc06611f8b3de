"""Scans: source files, their headers, pages' links."""

from __future__ import annotations

import os
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from weftgraph.functions.names import SOURCE_SUFFIXES, is_source, sanitised
from weftgraph.functions.text import without_block_comments, without_line_comment
from weftgraph.operators.fixpoint import settled, union_all

#: Names that listings of stores keep; other files below a root are never opened.
SOURCE_GLOB = "*{" + ",".join(SOURCE_SUFFIXES) + "}"
#: Entries of a folder, and bytes of texts, that a task hands on at once.
ENTRIES_AT_ONCE, BYTES_AT_ONCE = 10_000, 4 << 20
FOUND = "ord int, file string, steps array<string>"


def discovered(spark: SparkSession, roots: list[tuple[str, str]], entries_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(ord, file, steps) of the source files below roots (path, folder), in rounds over tables of folders.

    A folder is named by its canonical identity and visited once, whatever links lead to it: under the first root that
    reaches it, and there as the path with the fewest steps spells it, of these the first by its names. Hidden names are
    skipped. entries_of maps folders (folder, path) to what they hold: (folder, name, target, is_dir), target being the
    canonical identity of a folder; a folder that is missing or can't be read gives no rows. steps are the names below the root.
    """
    seen, found = [], []
    for k, (path, folder) in enumerate(roots):
        new = spark.createDataFrame([(folder, path.rstrip("/") or "/", [])], "folder string, path string, steps array<string>")
        if seen:
            new = settled(new.join(union_all(seen), "folder", "left_anti"))
        while not new.isEmpty():
            seen.append(new.select("folder"))
            held = entries_of(new.select("folder", "path")).where(~F.col("name").startswith(".")).join(new, "folder")
            spelled = F.concat(F.when(F.col("path") == "/", "").otherwise(F.col("path")), F.lit("/"), "name")
            held = settled(held.select("target", "is_dir", spelled.alias("path"), F.concat("steps", F.array("name")).alias("steps")))
            found.append(held.where(~F.col("is_dir") & is_source(F.col("path"))).select(F.lit(k).alias("ord"), F.col("path").alias("file"), "steps"))
            below = held.where("is_dir").groupBy(F.col("target").alias("folder")).agg(F.min(F.struct("steps", "path")).alias("best"))
            new = settled(below.join(union_all(seen), "folder", "left_anti").select("folder", "best.path", "best.steps"))
    return union_all(found) if found else spark.createDataFrame([], FOUND)


def _local(root: str) -> str | None:
    """The path of a root that is a folder of this machine or a mount, which may have links; None for stores."""
    plain = re.sub("^file:/+", "/", root)
    return None if re.match("[a-z][a-z0-9+.-]*:", plain) else plain


def local_entries(folders: DataFrame) -> DataFrame:
    """entries_of for folders of mounted file systems, listed by the tasks."""

    def listed(batches):
        for batch in batches:
            for folder, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    with os.scandir(path) as entries:
                        yield from packed(folder, entries)
                except OSError:
                    continue

    def packed(folder, entries):
        rows = []
        for e in entries:
            try:
                is_dir = e.is_dir()
            except OSError:
                is_dir = False
            rows.append((folder, e.name, os.path.realpath(e.path) if is_dir else e.path, is_dir))
            if len(rows) == at_once:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.string(), pa.string(), pa.string(), pa.bool_()))], names=["folder", "name", "target", "is_dir"])

    at_once = ENTRIES_AT_ONCE
    return folders.mapInArrow(listed, "folder string, name string, target string, is_dir boolean")


def local_texts(files: DataFrame) -> DataFrame:
    """files with text, read by the tasks; null where a file can't be read, is gone or is not UTF-8. files has a column file."""
    names = files.columns

    def read(batches):
        for batch in batches:
            at, texts, held = 0, [], 0
            for path in batch.column(names.index("file")).to_pylist():
                try:
                    with open(path, "rb") as f:
                        data = f.read()
                    text = data.decode()
                except (OSError, UnicodeDecodeError):
                    text = None
                texts.append(text)
                held += len(text or "")
                if held >= at_once:
                    yield joined(batch.slice(at, len(texts)), texts)
                    at, texts, held = at + len(texts), [], 0
            if texts:
                yield joined(batch.slice(at, len(texts)), texts)

    def joined(batch, texts):
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    at_once = BYTES_AT_ONCE
    return files.mapInArrow(read, StructType([*files.schema.fields, StructField("text", StringType())]))


def source_files(spark: SparkSession, roots: list[str]) -> DataFrame:
    """(file, text, ord) of source files below the roots, which may not all exist: hidden names are skipped.

    Folders are visited once each, also where roots lie in each other or lead to the same folder by links (see discovered).
    Roots in stores, which have no links, are listed by Spark's reader. Files that can't be read keep a row without text.
    """
    mounted = [(k, path) for k, r in enumerate(roots) if (path := _local(r)) is not None and os.path.isdir(path)]
    found = discovered(spark, [(path, os.path.realpath(path)) for _, path in mounted], local_entries)
    place = F.element_at(F.array(*[F.lit(k) for k, _ in mounted] or [F.lit(0)]), F.col("ord") + 1)
    out = local_texts(found.select("file", place.alias("ord"))).select("file", "text", "ord")
    for k, root in enumerate(roots):
        if _local(root) is not None:
            continue
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            continue
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", SOURCE_GLOB).load(root)
        below = F.substring(F.col("path"), F.lit(len(root.rstrip("/")) + 1), F.length("path"))
        out = out.unionByName(listed.where(is_source(F.col("path")) & ~below.rlike(r"/\.")).select(F.col("path").alias("file"), F.col("content").cast("string").alias("text"), F.lit(k).alias("ord")))
    first = F.row_number().over(W.partitionBy("file").orderBy("ord"))  # roots of stores may lie in each other
    return out.withColumn("n", first).where("n = 1").drop("n")


def source_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, text) of files (file, text) with block comments out, but their line breaks kept as they were."""
    return files.select("file", F.posexplode(F.split(without_block_comments(F.col("text")), "\n", -1)).alias("line_no", "text")).withColumn("line_no", F.col("line_no") + 1)


def header_tokens(lines: DataFrame) -> DataFrame:
    """(file, line_no, kind, name): what the first words of each line, without its line comment, declare."""
    w = F.split(F.trim(F.regexp_replace(without_line_comment(F.col("text")), r"\s+", " ")), " ")
    at = lambda i: F.coalesce(F.get(w, F.lit(i)), F.lit(""))
    kind = F.when(at(0) == "module", "module").when((at(0) == "import") | ((at(0) == "open") & (at(1) == "import")), "import")
    name = F.when(at(0) == "open", at(2)).otherwise(at(1))
    return lines.select("file", "line_no", kind.alias("kind"), sanitised(name).alias("name")).where("kind is not null and name != ''")


def headers(lines: DataFrame) -> DataFrame:
    """(file, module, imports): the first module named, and the sorted set of imports; files without a module header have none."""
    base = F.regexp_extract("file", r"([^/]*)\.[^/.]*$", 1)
    found = header_tokens(lines).groupBy("file").agg(
        F.min_by("name", F.when(F.col("kind") == "module", F.col("line_no"))).alias("module"),
        F.max(F.when(F.col("kind") == "module", 1)).alias("has"),
        F.sort_array(F.collect_set(F.when(F.col("kind") == "import", F.col("name")))).alias("imports"),
    )
    return found.where("has = 1").select("file", F.when(F.col("module") == "_", base).otherwise(F.col("module")).alias("module"), "imports")


def link_imports(pages: DataFrame) -> DataFrame:
    """(src, dst): hosts of pages and the first path segment or host that their links name."""
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    link = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return pages.select(host.alias("src"), link.alias("dst")).distinct()


def scan_sources(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(modules with their first file, imports, all files): a file without a header stays in the list of files."""
    found = headers(lines)
    modules = found.groupBy("module").agg(F.min("file").alias("file"))
    imports = found.select(F.col("module").alias("src"), F.explode("imports").alias("dst")).where("src != dst").distinct()
    return modules, imports, lines.select("file").distinct()


def keep_going(files: DataFrame, parse) -> tuple[DataFrame, DataFrame]:
    """(good, failures with module and reason): one bad source never stops the others.

    parse maps files to rows with a column reason, null where a source is good.
    """
    tried = parse(files)
    return tried.where("reason is null").drop("reason"), tried.where("reason is not null").select("module", "reason")
