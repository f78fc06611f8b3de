import random
import zlib

import numpy as np
import pytest

from weftgraph.llm import op5_token_files as files
from weftgraph.llm.word_tokens import word_tokens


@pytest.mark.parametrize("top", [2, 256, 257, 60000, 2**24, 2**32])
@pytest.mark.parametrize("n", [0, 1, 7, 8, 511, 512, 513, 5000])
def test_codes(top, n):
    ids = np.random.default_rng(n).integers(0, top, n).astype("<u4")
    codes = files.Codes(files.pack_codes(ids))
    assert codes.size == n
    assert (codes.slice(0, n) == ids).all()
    for i in range(0, n, 37):
        assert codes[i] == ids[i]
        assert (codes.slice(i, min(n, i + 100)) == ids[i : i + 100]).all()
    with pytest.raises(IndexError):
        codes[n]


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(files.default_file())
    r = random.Random(2)
    texts = ["", " ", "It's WE'RE <|endoftext|> x<|startoftext|>y", "ΑΣ ΣΑΣ İstanbul ẞ", "á éx ́", "1st 22nd\t.\n,;  '", "日本語テスト", "x" * 300, "a b c\x1cd\x85e​f", "don''t 's's", "É\x00é"]
    texts += ["".join(r.choice(" \n\t.,'<|>aeTH'sredé ßÉÏñ0123日́ ") for _ in range(r.randint(1, 60))) for _ in range(3000)]
    for t, got in zip(texts, word_tokens(files.default_file()).encode(texts)):
        assert np.frombuffer(got, "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_query_against_brute_force(spark, docs_with_odd_rows, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(files.default_file())
    path = f"file://{tmp_path}/tokens"
    files.write_tokens(docs_with_odd_rows.union(docs_with_odd_rows.limit(3)), path)
    got = [tuple(r) for r in files.read_index(spark, path).orderBy("start").collect()]
    rows = sorted(docs_with_odd_rows.union(docs_with_odd_rows.limit(3)).collect(), key=lambda r: r.doc_id)
    assert [g[0] for g in got] == [r.doc_id for r in rows]
    want, start = [], 0
    for r in rows:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


def test_empty_table(spark, docs_with_odd_rows, tmp_path):
    path = f"file://{tmp_path}/none"
    files.write_tokens(docs_with_odd_rows.limit(0), path)
    assert files.read_index(spark, path).collect() == []


def test_ids_by_place(spark, docs_with_odd_rows, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PLACES", 1000)
    path = f"file://{tmp_path}/tokens"
    files.write_tokens(docs_with_odd_rows.repartition(3), path)
    rows = spark.read.parquet(path).orderBy("part", "first").collect()
    every = np.concatenate([files.Codes(r.codes).slice(0, r.ends[-1]) for r in rows]).tolist()
    r = random.Random(3)
    asked = [0, len(every) - 1, len(every), -1, *(r.randrange(len(every)) for _ in range(300))]
    got = files.token_at(spark, path, spark.createDataFrame([(p,) for p in asked + asked[:5]], "position long")).collect()
    assert sorted((x.position, x.id) for x in got) == sorted((p, every[p]) for p in set(asked) if 0 <= p < len(every))
    spans = [(0, len(every)), (5, 5), (7, 3), (len(every) - 2, len(every) + 9), (-3, 4), *((a := r.randrange(len(every)), a + r.randrange(4000)) for _ in range(20))]
    got = files.tokens_between(spark, path, spark.createDataFrame(spans, "start long, end long")).collect()
    assert {(x.start, x.end): x.ids for x in got} == {(max(a, 0), z): every[max(a, 0) : max(z, 0)] if z > a else [] for a, z in spans}
