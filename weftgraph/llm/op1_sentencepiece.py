"""SentencePiece encoding and decoding by a shared-prefix forward pass.

The distinct marked words of a chunk of texts are sorted, which lays out their trie depth first,
and the forward states of the path from the root stay for the next word (piece_lattice). No step
shuffles: each task encodes its own rows with a bounded cache of words.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import chunks, keeps, kind_of, mapped, schema_of, short_reads, table
from weftgraph.llm.piece_lattice import ALONE_BYTES, CACHE_BYTES, MARK, PieceModel, PrefixStates, WordCache, marked_words

MODEL = "piece_bpe_32k.model"


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path(MODEL)


#: Bytes of text encoded at once: what that takes for a while lies between what the cache keeps.
AT_ONCE = 1 << 20


@lru_cache(maxsize=2)
def encoder(path: str, most: int = CACHE_BYTES) -> WordCache:
    keeps(__name__, encoder.cache_clear)
    model = PieceModel.load(path)
    units: dict[int, bytes] = {}

    def packed(states: PrefixStates) -> bytes:
        out = []
        for p in states.pieces():
            ids = units.get(p)
            if ids is None:
                ids = units[p] = np.array(model.unit_ids(p), dtype="<i4").tobytes()
            out.append(ids)
        return b"".join(out)

    return WordCache(model, packed, len, most)


def encode_texts(texts: list[str], cache: WordCache) -> list[bytes]:
    """Ids of each text as little-endian 32-bit integers."""
    split = marked_words if cache.model.splits_at_mark else (lambda t: [MARK + t.replace(" ", MARK)] if t else [])
    words = [split(t) for t in texts]
    known = cache.fill(set().union(*words)).__getitem__
    return [b"".join(map(known, w)) for w in words]


def decode_ids(ids: list[int], model: PieceModel) -> str:
    """The text of ids as the library gives it: marks are spaces, the first is dropped, byte pieces join."""
    table = _byte_table(model)
    out = b"".join(map(table.__getitem__, ids))
    text = out.decode("utf-8", "replace")
    return text[1:] if text[:1] == " " else text


def _byte_table(model: PieceModel) -> list[bytes]:
    found = model.__dict__.get("_table")
    if found is None:
        found = []
        for i, t in enumerate(model.texts):
            b = model.byte_values.get(i)
            found.append(bytes([b]) if b is not None else b"" if i in model.silent else " ⁇ ".encode() if i == model.unknown else t.replace(MARK, " ").encode())
        model._table = found
    return found


def _encode_batches(batches, path: str, text: str, ids: str):
    cache = encoder(path)
    for batch in batches:
        col = batch.column(text)
        texts = [t or "" for t in col.to_pylist()]
        for a, b in chunks([len(t) for t in texts], AT_ONCE):
            got = encode_texts(texts[a:b], cache)
            flat = np.frombuffer(b"".join(got), dtype="<i4")
            ends = np.concatenate([[0], np.cumsum([len(g) // 4 for g in got])]).astype("int32")
            part = batch.slice(a, b - a)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[*part.schema.names, ids])


def encode(df: DataFrame, text: str = "text", ids: str = "ids", model_path: str | None = None) -> DataFrame:
    """df with a column of token ids, exactly those of the sentencepiece library for the model.

    Nulls and empty texts give no ids. A column named like ids is replaced. Rows, their order within a
    partition and repeated rows stay.
    """
    keep = [c for c in df.columns if c != ids]
    run = partial(_encode_batches, path=model_path or default_model(), text=text, ids=ids)
    return mapped(df.select(*[F.col(f"`{c}`") for c in keep]), run, schema_of(df, keep, f"`{ids}` array<int>"))


def _decode_batches(batches, path: str, ids: str, out: str):
    model = encoder(path).model
    for batch in batches:
        texts = pa.array([None if x is None else decode_ids(x, model) for x in batch.column(ids).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, out])


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", model_path: str | None = None) -> DataFrame:
    """df with the text of each row's ids; null ids give null. U+2581 in a text comes back as a space."""
    keep = [c for c in df.columns if c != out]
    run = partial(_decode_batches, path=model_path or default_model(), ids=ids, out=out)
    return mapped(df.select(*[F.col(f"`{c}`") for c in keep]), run, schema_of(df, keep, f"`{out}` string"))


def _round_trip(batches, path: str):
    import hashlib
    import zlib

    cache = encoder(path, ALONE_BYTES)
    pieces = _byte_table(cache.model)
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        for a, b in chunks([len(t) for t in texts], AT_ONCE):
            got = encode_texts(texts[a:b], cache)
            flat = np.frombuffer(b"".join(got), dtype="<i4")
            sizes = [len(g) // 4 for g in got]
            ends = np.concatenate([[0], np.cumsum(sizes)]).astype("int32")
            back = [b"".join(map(pieces.__getitem__, np.frombuffer(g, "<i4").tolist()))[1:] for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id").slice(a, b - a),
                    pa.array(sizes, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
                    pa.array([zlib.crc32(g) for g in got], pa.int64()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in back], pa.string()),
                    pa.array([x == t.replace(MARK, " ").encode() for x, t in zip(back, texts[a:b])], pa.bool_()),
                ],
                names=["doc_id", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "round_trip"],
            )


def round_trip(docs: DataFrame, model_path: str | None = None) -> DataFrame:
    """Per document its ids, their number and crc32 (as little-endian 32-bit), and whether decoding them gives the text back.

    Null and empty texts: no ids, crc32 0, the digest of no bytes, round_trip true.
    """
    run = partial(_round_trip, path=model_path or default_model())
    return mapped(docs.select("doc_id", "text"), run, f"doc_id {kind_of(docs, 'doc_id')}, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    short_reads(spark)
    return round_trip(table(spark, sf_dir, "documents"))
