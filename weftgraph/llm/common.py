"""Helpers that the corpus operators share."""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator
from functools import partial
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker turns over at once.
CHUNK_BYTES = 4 << 20
#: Bytes of an Arrow batch between Spark and a worker, in place of Spark's 64 MB.
BATCH_BYTES, SPARK_BATCH_BYTES = 4 << 20, 64 << 20
BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of Parquet that Spark decodes at once where these are texts, in place of its 4,096: whole columns of so many lie on the heap.
READ_ROWS, SPARK_READ_ROWS = 512, 4096
READ_CONF = "spark.sql.parquet.columnarReaderBatchSize"

_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """What workers need: this package, by Spark's own file server, once per application; batches of bounded bytes.

    Texts are long, so a batch is bounded by bytes and not by rows alone. A session that sets its own bound keeps it.
    """
    if spark.conf.get(BATCH_CONF).rstrip("bB") == str(SPARK_BATCH_BYTES):
        spark.conf.set(BATCH_CONF, str(BATCH_BYTES))
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    root = Path(__file__).resolve().parents[1]
    d = tempfile.mkdtemp()  # the driver serves the file from there to executors while the application runs
    atexit.register(shutil.rmtree, d, ignore_errors=True)
    spark.sparkContext.addPyFile(shutil.make_archive(f"{d}/weftgraph-{app}", "zip", root.parent, root.name))


def short_reads(spark: SparkSession) -> None:
    """From now on this session reads Parquet in batches of READ_ROWS rows. A session that sets its own number keeps it."""
    if spark.conf.get(READ_CONF) == str(SPARK_READ_ROWS):
        spark.conf.set(READ_CONF, str(READ_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder in spark.checkpoint.dir; only a session on one machine may name none and gets one."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "weftgraph-checkpoints")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str, codec: str = "zstd", at_once: int | None = None) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts lineage and survives lost executors.

    Spark reads up to 4,096 rows of a row group at once; at_once, for rows of megabytes, makes row groups of so many.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weftgraph/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", codec)
    if at_once:
        writer = writer.option("parquet.block.row.count.limit", at_once)
    writer.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Delete the folders of stored frames, once nothing that still has to be computed reads them."""
    for df in frames:
        path = getattr(df, "_stored_at", None)
        if path:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores in front until df has no such column (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def kind_of(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def schema_of(df: DataFrame, columns: list[str], more: str = "") -> str:
    """DDL of these columns of df, and more."""
    return ", ".join([*(f"`{c}` {kind_of(df, c)}" for c in columns), *([more] if more else [])])


#: What releases what a worker keeps between tasks, by the module that keeps it.
_kept: dict[str, Callable[[], None]] = {}


def keeps(module: str, release: Callable[[], None]) -> None:
    """Note that this worker keeps something of a module's (a vocabulary, encoded words) until a task of another one comes."""
    _kept[module] = release


def _tidy(batches: Iterator, run: Callable) -> Iterator:
    own = getattr(run, "func", run).__module__
    for module in [m for m in _kept if m != own]:
        _kept.pop(module)()
    try:
        yield from run(batches)
    finally:
        # workers live on between tasks; what they have freed goes back to the machine
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)


def mapped(df: DataFrame, run: Callable, schema: str | object) -> DataFrame:
    """df.mapInArrow(run, schema), on a session that is prepared and with workers that give memory back."""
    prepare(df.sparkSession)
    return df.mapInArrow(partial(_tidy, run=run), schema)


def utf8(text: str | Column) -> Column:
    """The text's bytes; null counts as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def likely(df: DataFrame, wanted: DataFrame, key: str, bits: int = 1 << 23, others: bool = False) -> DataFrame:
    """df without most rows whose key isn't in wanted (its one column), or just those rows with others.

    This is a bitmap of fixed size (bits / 64 rows of 16 bytes at most), so it may be broadcast whatever the data.
    """
    place, word, mask, w = free_names(df, "place", "word", "mask", "w")
    of = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(bits))
    words = wanted.select(of(wanted.columns[0]).alias("p")).groupBy(F.shiftright("p", 6).alias(w)).agg(F.expr("bit_or(shiftleft(1L, cast(p % 64 as int)))").alias(mask))
    found = df.withColumn(place, of(key)).withColumn(word, F.shiftright(place, 6)).join(F.broadcast(words), F.col(word) == F.col(w), "left")
    hit = F.coalesce(F.expr(f"getbit({mask}, cast({place} % 64 as int)) = 1"), F.lit(False))
    return found.where(~hit if others else hit).select(*[F.col(f"`{c}`") for c in df.columns])


def chunks(sizes: list[int], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about limit; one row at least."""
    at, total = 0, 0
    for i, n in enumerate(sizes):
        if i > at and total + n > limit:
            yield at, i
            at, total = i, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)
