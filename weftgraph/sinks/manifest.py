"""Epochs of outputs, and a manifest of them, so that a run over unchanged facts writes nothing.

Many epochs become one by a fold that depends on their order: times a factor, plus the next, modulo 2**64. A
stretch of it is a pair (factor, sum), and pairs of neighbouring stretches combine, so tasks fold their own ranges
of the order, and only a pair for each range and slot is combined after that.
"""

from __future__ import annotations

from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.fixpoint import settled, union_all
from weftgraph.sinks.encode import FACTOR, START


MODULUS = 1 << 64
EPOCH = "decimal(20,0)"
MANIFEST = f"slot string, epoch {EPOCH}"


def row_epoch(*columns: Column) -> Column:
    """64 bits of a digest of the columns, as a whole number."""
    return F.conv(F.substring(F.md5(F.to_json(F.struct(*columns))), 1, 16), 16, 10).cast(EPOCH)


def combined_epochs(rows: DataFrame, order: list[str]) -> DataFrame:
    """(slot, epoch) of rows (slot, epoch, ...): a slot's epochs folded in the given order. A slot of any share of the rows is folded by many tasks."""
    start, factor, modulus = START, FACTOR, MODULUS

    def ranges(batches):
        from pyspark import TaskContext

        part, slot, pair = TaskContext.get().partitionId(), None, None
        for batch in batches:
            done = []
            for s, e in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if s != slot or pair is None:
                    if pair is not None:
                        done.append((slot, part, *pair))
                    slot, pair = s, (1, 0)
                pair = pair[0] * factor % modulus, (pair[1] * factor + int(e)) % modulus
            yield packed(done)
        if pair is not None:
            yield packed([(slot, part, *pair)])

    def packed(rows):
        types = (pa.string(), pa.int32(), pa.decimal128(20), pa.decimal128(20))
        values = [(s, p, Decimal(f), Decimal(x)) for s, p, f, x in rows]
        return pa.RecordBatch.from_arrays([pa.array([v[k] for v in values], t) for k, t in enumerate(types)], names=["slot", "part", "factor", "sum"])

    def whole(batches):
        slot, acc = None, None
        for batch in batches:
            done = []
            for s, f, x in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if s != slot or acc is None:
                    if acc is not None:
                        done.append((slot, acc))
                    slot, acc = s, start
                acc = (acc * int(f) + int(x)) % modulus
            yield folded(done)
        if acc is not None:
            yield folded([(slot, acc)])

    def folded(rows):
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([Decimal(r[1]) for r in rows], pa.decimal128(20))], names=["slot", "epoch"])

    dealt = rows.repartitionByRange("slot", *order).sortWithinPartitions("slot", *order).select("slot", F.col("epoch").cast(EPOCH).alias("epoch"))
    pairs = dealt.mapInArrow(ranges, "slot string, part int, factor decimal(20,0), sum decimal(20,0)")
    return pairs.repartition("slot").sortWithinPartitions("slot", "part").select("slot", "factor", "sum").mapInArrow(whole, MANIFEST)


def table_epochs(name: str, df: DataFrame, by: str | None = None) -> DataFrame:
    """(slot, epoch) of a table, whatever the order of its rows; with by, of each value of that column. A table without rows has a slot too."""
    slot = F.lit(name) if by is None else F.concat(F.lit(f"{name}/"), F.coalesce(F.col(by).cast("string"), F.lit("")))
    rows = df.select(slot.alias("slot"), row_epoch(*[F.col(f"`{c}`") for c in df.columns]).alias("epoch"))
    out = combined_epochs(rows, ["epoch"])
    if by is not None:
        return out
    none = df.sparkSession.createDataFrame([(name, Decimal(START))], MANIFEST)
    return out.unionByName(none).groupBy("slot").agg(F.coalesce(F.max(F.when(F.col("epoch") != START, F.col("epoch"))), F.max("epoch")).alias("epoch"))


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def stored_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest below path; empty if there is none or it can't be read, so that all is written anew."""
    files, where = _files(spark, f"{path}/_manifest")
    if not files.exists(where):
        return spark.createDataFrame([], MANIFEST)
    return settled(spark.read.schema(MANIFEST).option("ignoreCorruptFiles", "true").parquet(f"{path}/_manifest"))


def compared(now: DataFrame, before: DataFrame) -> DataFrame:
    """(slot, epoch, status): added, changed, same or removed."""
    both = now.join(before.select("slot", F.col("epoch").alias("old")), "slot", "full")
    return both.select("slot", "epoch", F.when(F.col("old").isNull(), "added").when(F.col("epoch").isNull(), "removed").when(F.col("epoch") != F.col("old"), "changed").otherwise("same").alias("status"))


def write_changed(tables: dict[str, DataFrame], path: str, by: dict[str, str] | None = None) -> DataFrame:
    """Write those tables below path whose rows aren't what the manifest there says; (slot, epoch, status) of all.

    Tables in by (name: column) have a folder, and a slot, for each value of that column, and only changed ones are
    replaced. The manifest is written last: a run that stops before leaves slots that are written again. Nothing is
    written if nothing has changed.
    """
    by = by or {}
    spark = next(iter(tables.values())).sparkSession
    epochs = union_all([table_epochs(name, df, by.get(name)) for name, df in tables.items()])
    status = settled(compared(epochs, stored_manifest(spark, path)))
    news = status.where("status != 'same'")
    if news.isEmpty():
        return status
    for name, df in tables.items():
        if name not in by:
            if not news.where(F.col("slot") == name).isEmpty():
                df.write.mode("overwrite").parquet(f"{path}/{name}")
            continue
        own = news.where(F.col("slot").startswith(f"{name}/")).select(F.substring(F.col("slot"), F.lit(len(name) + 2), F.length("slot")).alias("__key"), "status")
        fresh = df.withColumn("__key", F.coalesce(F.col(by[name]).cast("string"), F.lit(""))).join(own.where("status != 'removed'").select("__key"), "__key", "left_semi")
        fresh.drop("__key").repartition(by[name]).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by[name]).parquet(f"{path}/{name}")
        folder_of = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString
        for r in own.where("status = 'removed'").toLocalIterator():
            files, where = _files(spark, f"{path}/{name}/{folder_of(by[name], r['__key'])}")
            files.delete(where, True)
    status.where("status != 'removed'").select("slot", "epoch").coalesce(1).write.mode("overwrite").parquet(f"{path}/_manifest")
    return status
