"""Removal of repeated substrings of 200 bytes and more, by suffix arrays.

One array of a whole corpus fits no machine, so equal windows of 200 bytes are brought together
first. A window's anchor is its 64-byte piece with the smallest hash, which depends on the window's
bytes alone: equal windows have equal anchors at equal places. Consecutive windows with one anchor
make a context (about 270 bytes), and only contexts whose anchors are equal are compared:

 - an anchor that occurs once: nothing in its context repeats;
 - a context that occurs whole in two places: all of its windows repeat;
 - the other contexts of an anchor with several: they are cut to what any of the others shares, equal
   ones are folded to one string with a count, and the suffix array of a bucket's strings (linear
   grouping, suffix_array.py) has repeated windows side by side.

Contexts count as equal if two 64-bit hashes, the anchor's and their own, are; where they differ,
bytes decide. Contexts travel packed, some 25 bytes each, in as many buckets as the texts' bytes ask
for. Copies of a context that one step of a task finds are decided there and travel as one with a
count, so a passage in a third of all documents loads no bucket with its copies.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import discard, free_names, kind_of, likely, mapped, prepare, stored, table, utf8
from weftgraph.llm.shingles import LETTERS, mix, powers
from weftgraph.llm.suffix_array import suffix_array

LENGTH, PIECE = 200, 64
#: Windows that are hashed at once; a longer text is gone through in as many steps.
SLAB = 1 << 20
#: Symbols of one suffix array; strings beyond go to another (anchors stay together).
ARRAY = 1 << 20
#: Contexts packed at once, and bytes of a bucket of contexts, or of their strings.
PACK, BUCKET = 200_000, 8 << 20
#: About how many bytes of packed contexts a byte of text makes.
PACKED_SHARE = 0.45
NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The smallest of each w neighbours: running minima of blocks from both sides."""
    n = len(x)
    y = np.full(-(-n // w) * w, NEVER)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def contexts(data: np.ndarray, length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, start, end, anchor place) of a text's contexts; the windows of all of them are the text's."""
    out: list[tuple[np.ndarray, ...]] = []
    for a in range(0, max(0, len(data) - length + 1), SLAB):
        own = data[a : a + SLAB + length - 1]
        n = len(own)
        up, down = powers(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(LETTERS[own] * up[:n], dtype=np.uint64, out=total[1:])
        h = mix((total[piece:] - total[:-piece]) * down[: n - piece + 1])
        # the hash's upper half, then the place: the minimum is the smallest hash and of equals the first
        keyed = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        place = (sliding_min(keyed, length - piece + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        cut = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        end = np.append(cut[1:], len(place)) - 1 + length
        p = place[cut]
        whole = mix((total[end] - total[cut]) * down[cut]) ^ mix((p - cut).astype(np.uint64) << np.uint64(20) | (end - cut).astype(np.uint64))
        out.append((h[p], whole, cut + a, end + a, p + a))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


def _pack(rows: list[tuple], ids: pa.Array, hashes: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """rows: (contexts, number of the text in ids and hashes). One row a bucket, and rows of bucket -1 for what is decided here.

    A context that occurs again in these texts is repeated whole: its places go out as spans, and one of
    them stands for all towards other contexts, with their count.
    """
    anchor, context, lo, hi, at = (np.concatenate(x) for x in zip(*(r[0] for r in rows)))
    text = np.repeat([r[1] for r in rows], [len(r[0][0]) for r in rows])
    order = np.lexsort((context, anchor))
    anchor, context, lo, hi, at, text = (x[order] for x in (anchor, context, lo, hi, at, text))
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])]))
    copies = np.diff(np.append(first, len(anchor)))
    again = np.repeat(copies > 1, copies)
    bucket = (anchor[first] >> np.uint64(24)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    keys, parts = [], []
    for which in [np.flatnonzero(again), *np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1)]:
        if not len(which):
            continue
        decided = not keys and again.any()
        keys.append(-1 if decided else int(bucket[which[0]]))
        row = which if decided else first[which]
        own, ref = np.unique(text[row], return_inverse=True)
        body = [ref.astype("<u4"), lo[row].astype("<u4"), (hi - lo)[row].astype("<u2")]
        if not decided:
            body += [(at - lo)[row].astype("<u2"), anchor[row].astype("<u8"), context[row].astype("<u8"), copies[which].astype("<u4")]
        parts.append((own, hashes[own].astype("<i8").tobytes(), len(row), *(x.tobytes() for x in body), *[b""] * (7 - len(body))))
    # what is decided goes to buckets by turns
    spread = int(anchor[0] >> np.uint64(24)) % buckets
    ends = np.cumsum([0, *(len(x[0]) for x in parts)]).astype("int32")
    owners = pa.ListArray.from_arrays(pa.array(ends), ids.take(pa.array(np.concatenate([x[0] for x in parts]))))
    yield pa.RecordBatch.from_arrays(
        [pa.array([spread if k < 0 else k for k in keys], pa.int32()), pa.array([k < 0 for k in keys]), owners, pa.array([x[1] for x in parts], pa.binary()), pa.array([x[2] for x in parts], pa.int32()), *(pa.array([x[k] for x in parts], pa.binary()) for k in range(3, 10))],
        names=["bucket", "decided", "doc_ids", "hs", "n", "text", "lo", "size", "at", "anchor", "context", "copies"],
    )


def packed_schema(kind: str) -> str:
    return f"bucket int, decided boolean, doc_ids array<{kind}>, hs binary, n int, text binary, lo binary, size binary, at binary, anchor binary, context binary, copies binary"


def _context_batches(batches, buckets: int):
    for batch in batches:
        ids, hs = batch.column("doc_id"), batch.column("h").to_numpy()
        rows, n = [], 0
        for k, data in enumerate(batch.column("data")):
            found = contexts(np.frombuffer(data.as_buffer(), "u1"))
            if len(found[0]):
                rows.append((found, k))
                n += len(found[0])
            if n >= PACK:
                yield from _pack(rows, ids, hs, buckets)
                rows, n = [], 0
        if rows:
            yield from _pack(rows, ids, hs, buckets)


def _sort_bucket(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts of a bucket -> spans that repeat whole (anchor null), and contexts whose bytes have to be compared."""
    ids, held = [], [[] for _ in range(8)]
    n_texts = 0
    for batch in batches:
        lists, rows = batch.column("doc_ids"), batch.select(["decided", "hs", "n", "text", "lo", "size", "at", "anchor", "context", "copies"]).to_pylist()
        for k, r in enumerate(rows):
            own, hs = lists[k].values, np.frombuffer(r["hs"], "<i8")
            text, lo, size = np.frombuffer(r["text"], "<u4"), np.frombuffer(r["lo"], "<u4"), np.frombuffer(r["size"], "<u2")
            if r["decided"]:
                nothing = [pa.nulls(r["n"], t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
                hi = lo + size
                yield _found(own.take(pa.array(text)), hs[text], lo, hi, *nothing)
                continue
            ids.append(own)
            for column, x in zip(held, (text.astype(np.int64) + n_texts, lo, size, np.frombuffer(r["at"], "<u2"), np.frombuffer(r["anchor"], "<u8"), np.frombuffer(r["context"], "<u8"), np.frombuffer(r["copies"], "<u4"), hs)):
                column.append(x)
            n_texts += len(own)
    if not ids:
        return
    owners = pa.concat_arrays(ids)
    text, lo, size, at, anchor, context, copies, hs = (np.concatenate(x) for x in held)
    order = np.lexsort((context, anchor))
    text, lo, size, at, anchor, context, copies = (x[order] for x in (text, lo, size, at, anchor, context, copies))
    new_anchor = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    new = new_anchor | np.concatenate([[True], context[1:] != context[:-1]])
    first, group = np.flatnonzero(new), np.flatnonzero(new_anchor[new])
    total = np.add.reduceat(copies.astype(np.int64), first)  # of each context
    own_rows, kinds = np.diff(np.append(first, len(anchor))), np.diff(np.append(group, len(first)))
    # what one step counted several times is decided already; its other copies are here
    whole = np.flatnonzero((np.repeat(total, own_rows) > 1) & (copies == 1))
    nothing = [pa.nulls(len(whole), t) for t in (pa.int64(), pa.int64(), pa.int32(), pa.int64())]
    if len(whole):
        yield _found(owners.take(pa.array(text[whole])), hs[text[whole]], lo[whole], lo[whole] + size[whole], *nothing)
    # anchors all of whose contexts have copies need no comparing
    open_ = (kinds > 1) & (np.minimum.reduceat(total, group) == 1)
    asked = first[np.repeat(open_, kinds)]
    if len(asked):
        rest = [pa.array(anchor[asked].view(np.int64)), pa.array(context[asked].view(np.int64)), pa.array(at[asked].astype(np.int32)), pa.array(total[np.repeat(open_, kinds)])]
        yield _found(owners.take(pa.array(text[asked])), hs[text[asked]], lo[asked], lo[asked] + size[asked], *rest)


def _found(ids: pa.Array, hs: np.ndarray, lo: np.ndarray, hi: np.ndarray, *rest: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids, pa.array(hs.astype(np.int64)), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), *rest], names=["doc_id", "h", "lo", "hi", "anchor", "context", "at", "copies"])


def _shared(a: bytes, b: bytes) -> int:
    """How many first bytes two strings share."""
    m = min(len(a), len(b))
    x = int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")
    return m - (x.bit_length() + 7) // 8


def _furthest(parts: list[bytes]) -> list[int]:
    """For each string the most that any other shares with its beginning: neighbours in sorted order share the most."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:]):
        n = _shared(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def repeated_windows(strings: list[tuple[bytes, int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each (string, copies) the starts of its windows that occur elsewhere: all if it has copies, else by the suffix array."""
    text: list[int] = []
    home = []
    for k, (s, _) in enumerate(strings):
        home.append(len(text))
        text += s
        text.append(-1)
    blob = b"\0".join(s for s, _ in strings) + b"\0"
    order = np.array(suffix_array(text), np.int64)
    which = np.searchsorted(home, order, side="right") - 1
    sizes = np.array([len(s) for s, _ in strings])
    own = order - np.array(home)[which]
    fits = own + length <= sizes[which]  # windows inside their string: equal ones stand side by side
    order, which, own = order[fits], which[fits], own[fits]
    same = np.array([blob[a : a + length] == blob[b : b + length] for a, b in zip(order.tolist(), order[1:].tolist())], bool)
    hit = np.zeros(len(order), bool)
    hit[1:] |= same
    hit[:-1] |= same
    hit |= np.array([c > 1 for _, c in strings], bool)[which]
    out = [np.zeros(0, np.int64)] * len(strings)
    rank = np.lexsort((own[hit], which[hit]))
    w, o = which[hit][rank], own[hit][rank]
    cuts = np.searchsorted(w, np.arange(len(strings) + 1))
    return [o[a:b] for a, b in zip(cuts, cuts[1:])] if len(w) else out


def compared(groups: Iterator[list[tuple[int, bytes, int, int]]], length: int = LENGTH, piece: int = PIECE) -> Iterator[tuple[int, int, int]]:
    """groups: contexts (name, bytes, anchor's place, copies) of one anchor each -> (name, start, end) of repeated bytes.

    Ends are exclusive. Contexts with copies are partners; nothing is said about them.
    """
    strings: list[tuple[bytes, int]] = []
    holders: list[list[tuple[int, int]]] = []
    size = 0

    def flush():
        nonlocal strings, holders, size
        for starts, held in zip(repeated_windows(strings, length), holders):
            if len(starts):
                first = np.flatnonzero(np.concatenate([[True], starts[1:] != starts[:-1] + 1]))
                last = np.append(first[1:], len(starts)) - 1
                for name, shift in held:
                    for p, q in zip(starts[first].tolist(), starts[last].tolist()):
                        yield name, shift + p, shift + q + length
        strings, holders, size = [], [], 0

    for group in groups:
        right = _furthest([s[at + piece :] for _, s, at, _ in group])
        left = _furthest([s[:at][::-1] for _, s, at, _ in group])
        cut: dict[tuple[int, bytes], list] = {}
        for (name, s, at, copies), r, l in zip(group, right, left):
            if l + piece + r >= length:
                one = cut.setdefault((l, s[at - l : at + piece + r]), [0, []])
                one[0] += copies
                if copies == 1:
                    one[1].append((name, at - l))
        if any(held for _, held in cut.values()):
            if size and size + sum(len(s) for _, s in cut) > ARRAY:
                yield from flush()
            for (_, s), (copies, held) in cut.items():
                strings.append((s, copies))
                holders.append(held)
                size += len(s)
    if strings:
        yield from flush()


def _compare_bucket(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = pa.Table.from_batches(list(batches)).sort_by([("anchor", "ascending"), ("context", "ascending")])
    anchor, lo = rows.column("anchor").to_pylist(), rows.column("lo").to_pylist()
    data, at, copies = (rows.column(c) for c in ("data", "at", "copies"))

    def groups():
        first = 0
        for k in range(1, len(anchor) + 1):
            if k == len(anchor) or anchor[k] != anchor[first]:
                n = k - first
                yield list(zip(range(first, k), data.slice(first, n).to_pylist(), at.slice(first, n).to_pylist(), copies.slice(first, n).to_pylist()))
                first = k

    out = [(i, lo[i] + a, lo[i] + b) for i, a, b in compared(groups())]
    which = pa.array([r[0] for r in out], pa.int64())
    yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(which).combine_chunks(), rows.column("h").take(which).combine_chunks(), *(pa.array([r[k] for r in out], pa.int32()) for k in (1, 2))], names=["doc_id", "h", "lo", "hi"])


def _cut_batches(batches):
    for batch in batches:
        owner, columns = [], [[] for _ in range(6)]
        for k, (blob, wanted) in enumerate(zip(batch.column("data").to_pylist(), batch.column("wanted").to_pylist())):
            for w in wanted:
                owner.append(k)
                for column, v in zip(columns, (w["anchor"], w["context"], blob[w["lo"] : w["hi"]], w["lo"], w["at"], w["copies"])):
                    column.append(v)
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        which = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(which), batch.column("h").take(which), *(pa.array(v, t) for v, t in zip(columns, kinds))], names=["doc_id", "h", "anchor", "context", "data", "lo", "at", "copies"])


def joined_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), utf8("text").alias("data"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, h, spans array<struct<lo, hi>>), stored: each text's bytes that repeat, as spans that may overlap; h is its text's xxhash64.

    Texts without any have no row. Rows alike in id and text have one row, with each span as often.
    """
    spark = docs.sparkSession
    prepare(spark)
    kind, keyed = kind_of(docs, "doc_id"), _keyed(docs)
    long = keyed.where(F.length("data") >= LENGTH)
    partitions = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_bytes = long.agg(F.coalesce(F.sum(F.length("data")), F.lit(0))).first()[0]
    packed = mapped(long, partial(_context_batches, buckets=max(partitions, int(n_bytes * PACKED_SHARE) // BUCKET)), packed_schema(kind))
    schema = f"doc_id {kind}, h long, lo int, hi int, anchor long, context long, at int, copies long"
    found = stored(packed.groupBy("bucket").applyInArrow(_sort_bucket, schema), "substrings-found")
    asked = found.where("anchor is not null")
    wanted = asked.groupBy(F.col("doc_id").alias("id"), F.col("h").alias("k")).agg(F.collect_list(F.struct("anchor", "context", "lo", "hi", "at", "copies")).alias("wanted"))
    texts = likely(long, asked.select("h"), "h").join(wanted, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("h") == F.col("k"))).select("doc_id", "h", "data", "wanted")
    # rows alike in id and text are cut alike: one is enough
    cut = mapped(texts, _cut_batches, f"doc_id {kind}, h long, anchor long, context long, data binary, lo int, at int, copies long").dropDuplicates(["anchor", "context"])
    n_bytes = asked.agg(F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()[0]
    buckets = max(partitions, n_bytes // BUCKET)
    partly = cut.withColumn("bucket", F.pmod("anchor", F.lit(buckets))).groupBy("bucket").applyInArrow(_compare_bucket, f"doc_id {kind}, h long, lo int, hi int")
    both = found.where("anchor is null").select("doc_id", "h", "lo", "hi").unionByName(partly)
    spans = stored(both.groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans")), "substrings-spans")
    discard(found)
    return spans


def _digest_batches(batches):
    for batch in batches:
        rows = []
        for data, spans in zip(batch.column("data").to_pylist(), batch.column("spans").to_pylist()):
            gone = joined_spans([(s["lo"], s["hi"]) for s in spans or []])
            kept, at = hashlib.sha256(), 0
            for a, b in gone:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append((len(data), sum(b - a for a, b in gone), len(gone), kept.hexdigest()))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_batches(batches, text: str, spans: str):
    for batch in batches:
        out = []
        for own, found in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist()):
            data, parts, at = (own or "").encode(), [], 0
            for a, b in joined_spans([(s["lo"], s["hi"]) for s in found or []]):
                parts.append(data[at:a])
                at = b
            # a span can end inside a character: what is left of it goes
            out.append(own if not found else b"".join([*parts, data[at:]]).decode("utf-8", "ignore"))
        k = batch.schema.get_field_index(text)
        yield batch.set_column(k, batch.schema.field(k), pa.array(out, pa.string())).select([c for c in batch.schema.names if c != spans])


def _with_spans(keyed: DataFrame, spans: DataFrame, h: str, name: str) -> DataFrame:
    """keyed with each row's spans, or null. Only rows whose hash may have some are shuffled."""
    id_, k = free_names(keyed, "id", "k")
    right = spans.select(F.col("doc_id").alias(id_), F.col("h").alias(k), F.col("spans").alias(name))
    hashes = spans.select("h")
    some = likely(keyed, hashes, h).join(right, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(h) == F.col(k)), "left").drop(id_, k)
    none = likely(keyed, hashes, h, others=True).withColumn(name, F.lit(None).cast(right.schema[name].dataType))
    return some.unionByName(none)


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, ...) with repeated substrings cut from their texts; every row and column stays, null texts stay null."""
    h, name = free_names(docs, "h", "spans")
    keyed = docs.withColumn(h, F.xxhash64(F.coalesce("text", F.lit(""))))
    both = _with_spans(keyed, repeated_spans(docs), h, name).select(*[F.col(f"`{c}`") for c in docs.columns], name)
    return mapped(both, partial(_kept_batches, text="text", spans=name), docs.schema)


def digest(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes, maximal removed runs, and the sha256 of what is left; null counts as empty."""
    both = _with_spans(_keyed(docs), repeated_spans(docs), "h", "spans").select("doc_id", "data", "spans")
    return mapped(both, _digest_batches, f"doc_id {kind_of(docs, 'doc_id')}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(table(spark, sf_dir, "documents"))
