"""Token ids in files of directly addressable codes.

A segment's ids are split into chunks of 8 bits, lowest first. Level 0 has the first chunk of each
id; its bitmap says which ids go on, and level 1 has the next chunk of just these, and so on. A
directory of each bitmap's ones before every 64 bytes gives the rank that leads from one level to
the next, so any id is read without decoding those before it.

Documents are dealt by ranges of doc_id, sorted within, encoded and written as segments. Spark's
Parquet writer carries them, as it reaches any store; a row is one segment. Where a document
starts is the ids of earlier parts, of earlier segments of its part, and of the documents before it.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm.common import chunks, kind_of, mapped, shared_dir, table
from weftgraph.llm.word_tokens import word_tokens

FILE = "word_bpe_49k.json"
END_ID = 2
MAGIC = b"DAC1"
BLOCK = 64
#: Places of ids in a block that segments and asked places meet in.
PLACES = 1 << 20


def segment(kind: str) -> str:
    """Columns of a segment of documents whose ids are of that type."""
    return f"part int, first long, doc_ids array<{kind}>, ends array<long>, codes binary"


def default_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(FILE)


def pack_codes(ids: np.ndarray) -> bytes:
    """ids: unsigned 32-bit integers."""
    rest, out = ids.astype("<u4"), [MAGIC, struct.pack("<Q", len(ids))]
    while True:
        more = rest > 0xFF
        bits = np.packbits(more, bitorder="little")
        ones = np.bitwise_count(np.pad(bits, (0, -len(bits) % BLOCK))).reshape(-1, BLOCK).sum(axis=1, dtype=np.uint64)
        ranks = np.concatenate([[0], np.cumsum(ones)]).astype("<u8")
        out += [struct.pack("<Q", len(rest)), rest.astype("u1").tobytes(), bits.tobytes(), ranks.tobytes()]
        if not ranks[-1]:
            return b"".join(out)
        rest = rest[more] >> 8


class Codes:
    """Reads packed codes: one id, a range, or all."""

    def __init__(self, blob: bytes):
        if blob[:4] != MAGIC:
            raise ValueError("not a segment of codes")
        (self.size,) = struct.unpack_from("<Q", blob, 4)
        self.levels, at, n = [], 12, -1
        while n:
            (n,) = struct.unpack_from("<Q", blob, at)
            n_bits = (n + 7) // 8
            n_ranks = -(-n_bits // BLOCK) + 1
            at += 8
            low = np.frombuffer(blob, "u1", n, at)
            bits = np.frombuffer(blob, "u1", n_bits, at + n)
            ranks = np.frombuffer(blob, "<u8", n_ranks, at + n + n_bits)
            at += n + n_bits + 8 * n_ranks
            self.levels.append((low, bits, ranks))
            n = int(ranks[-1])

    def _rank(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before i."""
        _, bits, ranks = self.levels[level]
        byte, block = i // 8, i // (8 * BLOCK)
        n = int(ranks[block]) + int(np.bitwise_count(bits[block * BLOCK : byte]).sum(dtype=np.int64))
        return n + (int(bits[byte]) & (1 << i % 8) - 1).bit_count() if i % 8 else n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.size:
            raise IndexError(i)
        value, level = 0, 0
        while True:
            low, bits, _ = self.levels[level]
            value |= int(low[i]) << 8 * level
            if not bits[i // 8] >> i % 8 & 1:
                return value
            i = self._rank(level, i)
            level += 1

    def slice(self, a: int, b: int, level: int = 0) -> np.ndarray:
        """Ids a to b, without those before."""
        low, bits, _ = self.levels[level]
        out = low[a:b].astype("<u4")
        more = np.unpackbits(bits[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].astype(bool)
        if more.any():
            out[more] |= self.slice(self._rank(level, a), self._rank(level, b), level + 1) << 8
        return out


def _segments(batches, path: str, end_id: int):
    tokens, part, first = word_tokens(path), TaskContext.get().partitionId(), 0
    end = np.array([end_id], dtype="<u4").tobytes()
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        keys = batch.column("doc_id")
        for a, b in chunks([len(t) for t in texts]):
            got = [x + end for x in tokens.encode(texts[a:b])]
            ends = np.cumsum([len(x) // 4 for x in got])
            codes = pack_codes(np.frombuffer(b"".join(got), "<u4"))
            ids = keys.slice(a, b - a)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([ids.to_pylist()], pa.list_(ids.type)), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([codes], pa.binary())],
                names=["part", "first", "doc_ids", "ends", "codes"],
            )
            first += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, file: str | None = None, end_id: int = END_ID) -> None:
    """Write the ids of docs (doc_id, text) in ascending doc_id order; null ids come first, null texts count as empty.

    Ids are numbers or strings; other columns aren't written. Columns are not compressed, so that an id can be read without unpacking its neighbours. Rows of one doc_id are in the order of their texts' hashes, then texts, so reruns agree.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("h"))
    dealt = keyed.repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    mapped(dealt, partial(_segments, path=file or default_file(), end_id=end_id), segment(kind_of(docs, "doc_id"))).write.option("compression", "uncompressed").parquet(path)


def _read_batches(batches):
    for batch in batches:
        key = batch.column("doc_ids").type.value_type
        for row in batch.to_pylist():
            codes, start = Codes(row["codes"]), row["before"] + row["first"]
            ends = row["ends"]
            starts = [0, *ends[:-1]]
            crc = [zlib.crc32(codes.slice(a, b).tobytes()) for a, b in zip(starts, ends)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(row["doc_ids"], key), pa.array([start + a for a in starts], pa.int64()), pa.array([b - a for a, b in zip(starts, ends)], pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def placed_segments(spark: SparkSession, path: str) -> DataFrame:
    """Segments with before: the ids of all earlier parts. Parts are as many as tasks that wrote them."""
    files = spark.read.parquet(path)
    totals = files.groupBy("part").agg(F.sum(F.element_at("ends", -1)).alias("n"))
    before = totals.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return files.join(F.broadcast(before), "part")  # a row for each task that wrote


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: start, n_tokens and the crc32 of its ids."""
    placed = placed_segments(spark, path).select("before", "first", "doc_ids", "ends", "codes")
    return mapped(placed, _read_batches, f"doc_id {placed.schema['doc_ids'].dataType.elementType.simpleString()}, start long, n_tokens long, ids_crc32 long")


def _located(spark: SparkSession, path: str, asked: DataFrame, start: str, end: str) -> DataFrame:
    """asked, once for each segment that holds ids from start to end (exclusive), with part, first and the place (at) of the segment's first id.

    Both sides meet on blocks of places, of which a segment or a row of asked has as many as it is long; codes are not read for it.
    """
    placed = placed_segments(spark, path).select("part", "first", (F.col("before") + F.col("first")).alias("at"), F.element_at("ends", -1).alias("n")).where("n > 0")
    blocks = lambda a, z: F.explode(F.sequence(F.floor(a / PLACES), F.floor((z - 1) / PLACES))).alias("block")
    held = placed.select("*", blocks(F.col("at"), F.col("at") + F.col("n")))
    wanted = asked.where(F.col(end) > F.col(start)).select("*", blocks(F.col(start), F.col(end)))
    return wanted.join(held, "block").where((F.col(start) < F.col("at") + F.col("n")) & (F.col("at") < F.col(end))).drop("block", "n").distinct()


def _picked(batches):
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            codes = Codes(row["codes"])
            out += [(p, codes[p - row["at"]]) for p in row["positions"]]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(2)], names=["position", "id"])


def token_at(spark: SparkSession, path: str, positions: DataFrame) -> DataFrame:
    """(position, id) of the ids at places (position) of the files, counted over all of them from 0; each place once, and none beyond the last id.

    Segments that hold no asked place are not read, and of those read just the asked ids are looked up.
    """
    asked = positions.select(F.col("position").cast("long").alias("position"), (F.col("position") + 1).cast("long").alias("end")).where("position >= 0").distinct()
    by = _located(spark, path, asked, "position", "end").groupBy("part", "first", "at").agg(F.collect_list("position").alias("positions"))
    return mapped(spark.read.parquet(path).select("part", "first", "codes").join(by, ["part", "first"]).select("at", "positions", "codes"), _picked, "position long, id long")


def _sliced(batches):
    for batch in batches:
        rows = batch.to_pylist()
        got = []
        for row in rows:
            codes = Codes(row["codes"])
            got.append(codes.slice(max(0, row["start"] - row["at"]), min(codes.size, row["end"] - row["at"])).astype(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("start", "end", "at")), pa.array(got, pa.list_(pa.int64()))], names=["start", "end", "at", "ids"])


def tokens_between(spark: SparkSession, path: str, ranges: DataFrame) -> DataFrame:
    """(start, end, ids) of ranges (start, end) of places, end exclusive; places beyond the last id are left out, and an empty or repeated range counts once."""
    asked = ranges.select(F.greatest(F.col("start").cast("long"), F.lit(0)).alias("start"), F.col("end").cast("long").alias("end")).distinct()
    there = _located(spark, path, asked, "start", "end")
    parts = mapped(spark.read.parquet(path).select("part", "first", "codes").join(there, ["part", "first"]).select("start", "end", "at", "codes"), _sliced, "start long, end long, at long, ids array<long>")
    whole = parts.groupBy("start", "end").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "ids"))), lambda s: s["ids"])).alias("ids"))
    return asked.join(whole, ["start", "end"], "left").select("start", "end", F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/weftgraph/tokens-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_index(spark, path)
