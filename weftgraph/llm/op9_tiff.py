"""Media columns: TIFF images, written and read without an imaging library.

Reading walks the chain of image directories, decodes PackBits, LZW or deflate strips and tiles,
undoes the horizontal predictor and gives one row per page. The query stores each text's bytes as
8-bit grey pages and takes its figures from what it reads back. No step shuffles.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import chunks, kind_of, mapped, schema_of, table, utf8

# Fixed values of the format: tag numbers, compression codes, bytes of each field type.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 273, 277, 278, 279, 284, 317
TILE_W, TILE_H, TILE_AT, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
CODES = {"none": NONE, "lzw": LZW, "deflate": DEFLATE, "packbits": PACKBITS}

#: Bytes of a page that is read, unless the caller allows more, and of each byte that a code can hold (LZW's is the most).
MOST_BYTES, EXPANDS = 1 << 28, 2600
#: Layout of the query's images.
ROW, PAGE_ROWS, ROWS_PER_STRIP = 64, 1024, 256


class BadTiff(ValueError):
    """The bytes are not a TIFF file that this reader understands."""


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i >= 3:
            out += bytes((257 - (j - i), data[i]))
        else:
            j = i
            while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size and i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


def _lzw_width(entries: int) -> int:
    """Bits of a code; this format widens one code early."""
    return 9 if entries < 511 else 10 if entries < 1023 else 11 if entries < 2047 else 12


def lzw(data: bytes) -> bytes:
    bits, n_bits = 0, 0
    codes, fresh = {bytes([i]): i for i in range(256)}, 258
    known = dict(codes)

    def put(code: int, width: int) -> None:
        nonlocal bits, n_bits
        bits, n_bits = bits << width | code, n_bits + width

    put(256, 9)
    prefix = b""
    for k in range(len(data)):
        longer = prefix + data[k : k + 1]
        if longer in known:
            prefix = longer
            continue
        put(known[prefix], _lzw_width(fresh))
        known[longer] = fresh
        fresh += 1
        if fresh == 4094:
            put(256, 12)
            known, fresh = dict(codes), 258
        prefix = data[k : k + 1]
    if prefix:
        put(known[prefix], _lzw_width(fresh))
        fresh += 1
    put(257, _lzw_width(fresh))
    pad = -n_bits % 8
    return (bits << pad).to_bytes((n_bits + pad) // 8, "big")


def unlzw(data: bytes, size: int) -> bytes:
    out, entries, before = bytearray(), [], b""
    acc = have = at = 0
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    entries = list(first)
    while len(out) < size:
        width = _lzw_width(len(entries) + bool(before))
        while have < width and at < len(data):
            acc, have, at = (acc << 8 | data[at]) & 0xFFFFFF, have + 8, at + 1
        if have < width:
            break
        code = acc >> have - width & (1 << width) - 1
        have -= width
        if code == 257:
            break
        if code == 256:
            entries, before = list(first), b""
            continue
        if code < len(entries):
            now = entries[code]
        elif code == len(entries) and before:
            now = before + before[:1]
        else:
            raise BadTiff("an LZW code that no entry has")
        if before:
            entries.append(before + now[:1])
        out += now
        before = now
    return bytes(out)


def _compress(data: bytes, code: int) -> bytes:
    if code == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, LZW: lzw, PACKBITS: pack_bits}[code](data)


def _expand(data: bytes, code: int, size: int) -> bytes:
    if code in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise BadTiff(str(e)) from None
    if code == NONE:
        return data
    if code in (LZW, PACKBITS):
        return (unlzw if code == LZW else unpack_bits)(data, size)
    raise BadTiff(f"compression {code}")


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", predictor: int = 1, tile: tuple[int, int] | None = None, strip_rows: int = ROWS_PER_STRIP) -> bytes:
    """A little-endian file of pages, each an array height x width (x samples) of unsigned 8 or 16 bits."""
    out, code, link = bytearray(struct.pack("<2sHI", b"II", 42, 0)), CODES[compression], 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        page = page.astype(page.dtype.newbyteorder("<"), copy=False)
        height, width, samples = page.shape
        if tile:
            tall, wide = tile
            grid = np.pad(page, ((0, -height % tall), (0, -width % wide), (0, 0)))
            cells = [grid[y : y + tall, x : x + wide] for y in range(0, grid.shape[0], tall) for x in range(0, grid.shape[1], wide)]
        else:
            cells = [page[y : y + strip_rows] for y in range(0, height, strip_rows)]
        at, sizes = [], []
        for cell in cells:
            if predictor == 2:
                cell = np.concatenate([cell[:, :1], cell[:, 1:] - cell[:, :-1]], axis=1)
            data = _compress(np.ascontiguousarray(cell).tobytes(), code)
            at.append(len(out))
            sizes.append(len(data))
            out += data + b"\0" * (len(data) % 2)
        fields = [(WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [8 * page.itemsize] * samples), (COMPRESSION, 3, [code]), (PHOTOMETRIC, 3, [2 if samples == 3 else 1]), (SAMPLES, 3, [samples]), (PLANAR, 3, [1]), (PREDICTOR, 3, [predictor])]
        fields += [(TILE_W, 4, [tile[1]]), (TILE_H, 4, [tile[0]]), (TILE_AT, 4, at), (TILE_BYTES, 4, sizes)] if tile else [(STRIP_AT, 4, at), (STRIP_ROWS, 4, [strip_rows]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, kind, values in sorted(fields):
            packed = struct.pack(f"<{len(values)}{'HI'[kind == 4]}", *values)
            if len(packed) > 4:
                place = len(out)
                out += packed + b"\0" * (len(packed) % 2)
                packed = struct.pack("<I", place)
            entries += struct.pack("<HHI", tag, kind, len(values)) + packed.ljust(4, b"\0")
        struct.pack_into("<I", out, link, len(out))
        link = len(out) + 2 + len(entries)
        out += struct.pack("<H", len(fields)) + entries + b"\0\0\0\0"
    return bytes(out)


def read_directories(blob: bytes) -> Iterator[dict[int, list[int]]]:
    """The whole-number fields of each image directory in the chain, by tag."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(blob[:2]))
    try:
        if order is None or struct.unpack_from(order + "H", blob, 2)[0] != 42:
            raise BadTiff("no TIFF header")
        at, seen = struct.unpack_from(order + "I", blob, 4)[0], set()
        while at:
            if at in seen:
                raise BadTiff("the directories form a loop")
            seen.add(at)
            (n,) = struct.unpack_from(order + "H", blob, at)
            fields = {}
            for k in range(n):
                entry = at + 2 + 12 * k
                tag, kind, count = struct.unpack_from(order + "HHI", blob, entry)
                letter = {1: "B", 3: "H", 4: "I"}.get(kind)
                if letter is None:
                    continue
                if count > len(blob):
                    raise BadTiff("a field longer than the file")
                place = entry + 8 if count * FIELD_BYTES[kind] <= 4 else struct.unpack_from(order + "I", blob, entry + 8)[0]
                fields[tag] = list(struct.unpack_from(f"{order}{count}{letter}", blob, place))
            fields["order"] = order
            yield fields
            (at,) = struct.unpack_from(order + "I", blob, at + 2 + 12 * n)
    except struct.error as e:
        raise BadTiff(f"cut off: {e}") from None


def read_page(blob: bytes, fields: dict, most: int = MOST_BYTES) -> np.ndarray:
    """Samples of one page, height x width x samples; BadTiff if these are more than most bytes."""
    try:
        width, height = fields[WIDTH][0], fields[HEIGHT][0]
        samples = fields.get(SAMPLES, [1])[0]
        bits, code, predictor = fields.get(BITS, [1])[0], fields.get(COMPRESSION, [NONE])[0], fields.get(PREDICTOR, [1])[0]
        if bits not in (8, 16) or fields.get(PLANAR, [1])[0] != 1 and samples > 1 or predictor not in (1, 2):
            raise BadTiff(f"{bits} bits, predictor {predictor}")
        tiled = TILE_AT in fields
        tall, wide = (fields[TILE_H][0], fields[TILE_W][0]) if tiled else (min(fields.get(STRIP_ROWS, [height])[0], height), width)
        places, sizes = (fields[TILE_AT], fields[TILE_BYTES]) if tiled else (fields[STRIP_AT], fields[STRIP_BYTES])
        across = -(-width // wide)
        if len(places) != len(sizes) or len(places) < across * -(-height // tall):
            raise BadTiff("strips or tiles don't cover the page")
        n_bytes = width * height * samples * bits // 8
        if n_bytes > most or n_bytes > EXPANDS * sum(sizes):
            raise BadTiff("a page of more bytes than its strips or tiles can hold, or than are allowed")
    except (KeyError, IndexError, ZeroDivisionError):
        raise BadTiff("a needed field is missing") from None
    kind = np.dtype("u1" if bits == 8 else fields["order"] + "u2")
    page = np.zeros((height, width, samples), dtype=kind.newbyteorder("="))
    for k in range(across * -(-height // tall)):
        y, x = k // across * tall, k % across * wide
        rows = tall if tiled else min(tall, height - y)
        want = rows * wide * samples * kind.itemsize
        data = _expand(blob[places[k] : places[k] + sizes[k]], code, want)
        if len(data) < want:
            raise BadTiff("a strip or tile is too short")
        cell = np.frombuffer(data, kind, rows * wide * samples).reshape(rows, wide, samples).astype(page.dtype)
        if predictor == 2:
            cell = np.cumsum(cell, axis=1, dtype=page.dtype)
        page[y : y + rows, x : x + wide] = cell[: height - y, : width - x]
    return page


def read_tiff(blob: bytes) -> Iterator[tuple[dict, np.ndarray]]:
    for fields in read_directories(blob):
        yield fields, read_page(blob, fields)


def _page_rows(batches, media: str, most: int):
    for batch in batches:
        rest = [c for c in batch.schema.names if c != media]
        for i, blob in enumerate(batch.column(media).to_pylist()):
            if blob is None:
                continue
            rows: list[tuple] = []
            try:
                for k, fields in enumerate(read_directories(blob)):
                    try:
                        page = read_page(blob, fields, most)
                    except BadTiff as e:
                        rows.append((k, None, None, None, None, None, None, str(e)))
                        continue
                    rows.append((k, page.shape[1], page.shape[0], page.shape[2], 8 * page.itemsize, fields.get(COMPRESSION, [NONE])[0], page.tobytes(), None))
            except BadTiff as e:
                rows.append((len(rows), None, None, None, None, None, None, str(e)))
            for r in rows:
                names = ["page", "width", "height", "samples", "bits", "compression", "pixels", "error"]
                kinds = [pa.int32()] * 6 + [pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in rest), *(pa.array([v], t) for v, t in zip(r, kinds))], names=[*rest, *names])


def read_pages(df: DataFrame, media: str = "media", most: int = MOST_BYTES) -> DataFrame:
    """One row per page of each image: its other columns, page from 0, width, height, samples, bits, compression and pixels.

    Pixels are native-endian samples in rows. Null media give no row; a page that can't be read gives
    a row with null figures and the reason in error, and so does the place where the chain of pages breaks off. Columns of df with the names
    of the new ones are left out.
    """
    made = {"page", "width", "height", "samples", "bits", "compression", "pixels", "error"}
    keep = [c for c in df.columns if c != media and c not in made]
    schema = schema_of(df, keep, "page int, width int, height int, samples int, bits int, compression int, pixels binary, error string")
    return mapped(df.select(*[F.col(f"`{c}`") for c in [*keep, media]]), partial(_page_rows, media=media, most=most), schema)


def store_bytes(data: bytes) -> bytes:
    """data, padded with 0 to a positive multiple of 64, as grey pages of 64 samples a row."""
    rows = np.frombuffer(data.ljust(max(ROW, len(data) + -len(data) % ROW), b"\0"), "u1").reshape(-1, ROW)
    return write_tiff([rows[a : a + PAGE_ROWS] for a in range(0, len(rows), PAGE_ROWS)], "deflate", 2)


def _features(pages: list[np.ndarray]) -> str:
    rows = np.concatenate(pages)[:, :, 0].astype(np.int32)
    edge = int(np.abs(rows[:, 1:] - rows[:, :-1]).sum())
    return f"pages={len(pages)};rows={len(rows)};sum={int(rows.sum(dtype=np.int64))};max={int(rows.max())};edge={edge};distinct={len(np.unique(rows))}"


def _store_batches(batches):
    for batch in batches:
        col = batch.column("data")
        blobs = col.to_pylist()
        for a, b in chunks([len(x) for x in blobs]):
            out: list[tuple] = []
            for data in blobs[a:b]:
                media = store_bytes(data)
                pages = [page for _, page in read_tiff(media)]
                payload = b"".join(p.tobytes() for p in pages)
                out.append((len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), _features(pages)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(v, t) for v, t in zip(zip(*out), kinds))], names=["doc_id", *names])


def media_digest(docs: DataFrame) -> DataFrame:
    """Per document the digests and figures of its text stored as an image and read back; null counts as empty."""
    return mapped(
        docs.select("doc_id", utf8("text").alias("data")), _store_batches, f"doc_id {kind_of(docs, 'doc_id')}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def _media_batches(batches, data: str, media: str):
    for batch in batches:
        made = pa.array([None if x is None else store_bytes(x) for x in batch.column(data).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, media])


def with_media(df: DataFrame, data: str, media: str = "media") -> DataFrame:
    """df with the binary column stored as an image; null stays null."""
    keep = [c for c in df.columns if c != media]
    return mapped(df.select(*[F.col(f"`{c}`") for c in keep]), partial(_media_batches, data=data, media=media), schema_of(df, keep, f"`{media}` binary"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digest(table(spark, sf_dir, "documents"))
