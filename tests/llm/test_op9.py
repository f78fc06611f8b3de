import hashlib
import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import op9_tiff as tiff


@pytest.mark.parametrize("compression", list(tiff.CODES))
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("shape,kind", [((37, 50), "u1"), ((300, 33, 3), "u1"), ((20, 17), "u2"), ((1, 1), "u1")])
def test_round_trip(compression, predictor, tile, shape, kind):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 60 if k else 4, shape).astype(kind) for k in range(2)]
    back = [p for _, p in tiff.read_tiff(tiff.write_tiff(pages, compression, predictor, tile))]
    assert len(back) == 2
    for a, b in zip(pages, back):
        assert (a.reshape(b.shape) == b).all()


def test_codecs_on_bytes():
    r = random.Random(3)
    for n in (0, 1, 2, 3, 127, 128, 129, 130, 5000, 70000):
        for data in (bytes(r.randrange(256) for _ in range(n)), bytes(r.choice(b"aab") for _ in range(n)), b"x" * n):
            assert tiff.unpack_bits(tiff.pack_bits(data), n) == data
            assert tiff.unlzw(tiff.lzw(data), n) == data


def test_lzw_known_bytes():
    # the worked example of the TIFF 6.0 text: codes 256 7 258 8 8 258 6 6 257
    data = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    bits = "".join(f"{c:09b}" for c in (256, 7, 258, 8, 8, 258, 6, 6, 257))
    packed = int(bits + "0" * (-len(bits) % 8), 2).to_bytes((len(bits) + 7) // 8, "big")
    assert tiff.lzw(data) == packed
    assert tiff.unlzw(packed, len(data)) == data


def test_big_endian_and_bad_files():
    import struct

    ifd = [(256, 3, 1, 2 << 16), (257, 3, 1, 1 << 16), (258, 3, 1, 8 << 16), (273, 4, 1, 8), (279, 4, 1, 2), (278, 3, 1, 1 << 16)]
    blob = struct.pack(">2sHI", b"MM", 42, 10) + b"\x05\x09" + struct.pack(">H", len(ifd)) + b"".join(struct.pack(">HHII", *e) for e in sorted(ifd)) + b"\0" * 4
    assert [p.ravel().tolist() for _, p in tiff.read_tiff(blob)] == [[5, 9]]
    good = tiff.store_bytes(b"hello" * 50)
    for bad in (b"", b"II", b"xx*\0", good[:-9], good[:8] + b"\xff" * 40 + good[48:]):
        with pytest.raises(tiff.BadTiff):
            list(tiff.read_tiff(bad))


def test_pages_operator(spark):
    good = tiff.write_tiff([np.arange(64, dtype="u1").reshape(8, 8)] * 3)
    df = spark.createDataFrame([(1, bytearray(good), "a"), (2, None, "b"), (3, bytearray(b"junk"), "c"), (1, bytearray(good), "a")], "id long, media binary, page string")
    rows = tiff.read_pages(df).collect()
    assert sorted((r.id, r.page, r.error is None) for r in rows) == [(1, 0, True), (1, 0, True), (1, 1, True), (1, 1, True), (1, 2, True), (1, 2, True), (3, 0, False)]
    assert tiff.read_pages(df.limit(0)).collect() == []


def test_pages_after_a_damaged_one(spark):
    pages = [np.full((8, 8), k, "u1") for k in range(3)]
    blob = bytearray(tiff.write_tiff(pages, "deflate"))
    at = list(tiff.read_directories(bytes(blob)))[1][tiff.STRIP_AT][0]
    blob[at : at + 2] = b"\xff\xff"
    rows = sorted(tiff.read_pages(spark.createDataFrame([(1, blob)], "id long, media binary")).collect(), key=lambda r: r.page)
    assert [(r.page, r.error is None, r.pixels and bytes(r.pixels)) for r in rows] == [(0, True, bytes(64)), (1, False, None), (2, True, b"\x02" * 64)]


def test_query_against_brute_force(spark, docs_with_odd_rows):
    got = {(r.doc_id, r.payload_sha256): r for r in tiff.media_digest(docs_with_odd_rows).collect()}
    for r in docs_with_odd_rows.collect():
        data = (r.text or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        row = got[r.doc_id, hashlib.sha256(payload).hexdigest()]
        assert (row.n_bytes, row.payload_bytes, row.tail_crc32) == (len(data), len(payload), zlib.crc32(payload[-64:]))
        assert row.media_sha256 == hashlib.sha256(tiff.store_bytes(data)).hexdigest()
