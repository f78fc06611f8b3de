import random

import numpy as np
import pytest
import sentencepiece

from weftgraph.llm import op1_sentencepiece as op1
from weftgraph.llm import op2_token_counts as op2
from weftgraph.llm.piece_lattice import PieceModel, PrefixStates


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=op1.default_model())


def odd_texts():
    r = random.Random(1)
    fixed = ["", " ", "  ", "a  b", " a", "a ", "▁", "▁▁x ▁ y", "日本語 テスト\n\n\tx", "\x00", "<s> </s> <unk> <0x0A>", "    def f(x):\n        return  x  ", "🙂🙃 🙂", "a" * 3000, "éèế", "aaaa " * 300, " x y"]
    return fixed + ["".join(r.choice("  \n▁aetinsrho.,THé日🙂0123\t") for _ in range(r.randint(1, 40))) for _ in range(2000)]


def test_ids_and_text_are_the_librarys(library):
    cache, texts = op1.encoder(op1.default_model()), odd_texts()
    for t, got in zip(texts, op1.encode_texts(texts, cache)):
        ids = np.frombuffer(got, "<i4").tolist()
        assert ids == library.encode(t), t
        assert op1.decode_ids(ids, cache.model) == library.decode(ids)


def test_states_are_shared_in_sorted_order():
    model = PieceModel.load(op1.default_model())
    words = sorted({"▁" + a + b for a in ("there", "therm", "thing", "other") for b in ("", "s", "ing", "ness", ".")})
    shared = PrefixStates(model)
    for w in words:
        shared.advance(w)
        alone = PrefixStates(model)
        alone.advance(w)
        assert shared.count == alone.count and shared.last == alone.last and shared.pieces() == alone.pieces()
    assert shared.steps < sum(map(len, words)) / 2


def test_unigram_against_brute_force():
    r = random.Random(4)
    pieces = [("<unk>", 0.0, "unknown")] + [(p, -r.random() * 5, "normal") for p in ("▁", "a", "b", "ab", "ba", "aab", "▁a", "bb", "▁ab")]
    model = PieceModel(pieces, "unigram", False)

    def best(w):
        scores = [0.0] + [None] * len(w)
        for i in range(1, len(w) + 1):
            options = [scores[j] + model.scores[model.ids[w[j:i]]] for j in range(i) if w[j:i] in model.ids]
            if w[i - 1] not in model.ids:
                options.append(scores[i - 1] + model.unknown_score)
            scores[i] = max(options)
        return scores[-1]

    states = PrefixStates(model)
    for w in sorted("▁" + "".join(r.choice("abc") for _ in range(r.randint(0, 9))) for _ in range(200)):
        states.advance(w)
        ids = [i for p in states.pieces() for i in model.unit_ids(p)]
        own = sum(model.unknown_score if i == model.unknown else model.scores[i] for i in ids)
        assert abs(own - best(w)) < 1e-9 and abs(states.score[-1] - own) < 1e-9


def test_counts_of_every_prefix(library):
    cache = op2.counter(op1.default_model())
    for t in odd_texts()[:400]:
        got = op2.prefix_counts(t, cache)
        if len(t) < 200:
            assert got.tolist() == [len(library.encode(t[:i])) for i in range(len(t) + 1)], t
        assert got[-1] == len(library.encode(t))
        for budget in (0, 3, 17):
            n = op2.chars_within(t, budget, cache)
            assert n == np.flatnonzero(got <= budget)[-1], (t, budget)


def test_long_words_take_memory_in_proportion(library):
    """One unspaced word of a million letters: its states and values, not those of all its prefixes together."""
    import tracemalloc

    r = random.Random(3)
    t = "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/", k=1_000_000))
    caches = op1.encoder(op1.default_model()), op2.counter(op1.default_model())
    tracemalloc.start()
    got = np.frombuffer(op1.encode_texts([t], caches[0])[0], "<i4")
    n = op2.chars_within(t, 4096, caches[1])
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()
    assert got.tolist() == library.encode(t)
    assert len(library.encode(t[:n])) <= 4096


def test_counts_at_the_border_of_a_byte(library):
    """Unspaced words of 250 to 260 tokens, of which some have a prefix of more tokens than a byte holds and the whole has not."""
    r, cache, longer = random.Random(8), op2.counter(op1.default_model()), 0
    pieces = ["there", "ation", "ness", "ing", "aZ9", "q0/", "Straße", "日本", "_x", "00"]
    for last in ("international", "ation", "there", "strings"):
        text = ""
        while len(library.encode(text)) < 250:
            text += r.choice(pieces)
        base = text
        while len(library.encode(text)) < 261:
            for t in (text, text + last):
                want = [len(library.encode(t[:k])) for k in range(len(t) + 1)]
                longer += want[-1] < 256 <= max(want)
                assert op2.prefix_counts(t, cache).tolist() == want
            text += r.choice("qZ9x")
        assert text != base
    assert longer


def test_queries(spark, library, docs_with_odd_rows):
    import hashlib
    import zlib

    rows = sorted((r.doc_id, r.text or "") for r in docs_with_odd_rows.collect())
    got = sorted(tuple(r) for r in op2.token_counts(docs_with_odd_rows, limit=50).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect())
    assert got == sorted((d, len(t.encode()), len(library.encode(t)), len(library.encode(t)) > 50) for d, t in rows)
    out = op1.round_trip(docs_with_odd_rows).collect()
    want = sorted((d, library.encode(t), zlib.crc32(np.array(library.encode(t), "<i4").tobytes()), hashlib.sha256(t.replace("▁", " ").encode()).hexdigest(), True) for d, t in rows)
    assert sorted((r.doc_id, r.ids, r.ids_crc32, r.decoded_sha256, r.round_trip) for r in out) == want
    coded = op1.encode(docs_with_odd_rows)
    assert coded.columns == [*docs_with_odd_rows.columns, "ids"]
    back = op1.decode(coded.select("doc_id", "ids")).collect()
    assert sorted((r.doc_id, r.decoded) for r in back) == sorted((d, t.replace("▁", " ")) for d, t in rows)
    assert op1.encode(docs_with_odd_rows.limit(0)).collect() == [] and op2.token_counts(docs_with_odd_rows.limit(0)).collect() == []


def test_words_stay_up_to_the_cache_of_each_use():
    """Counting and the round trip keep more words than a pipeline's encoding, and give the same ids."""
    path = op1.default_model()
    wide, narrow = op1.encoder(path, 120 << 20), op1.encoder(path)
    for cache, stays in ((wide, True), (narrow, False), (op2.counter(path), True)):
        cache.fill({"▁there"})
        cache.held = 60 << 20
        cache.fill({"▁other"})
        assert ("▁there" in cache.words) == stays
    assert op1.encode_texts(["there other thing"], wide) == op1.encode_texts(["there other thing"], narrow)
    op1.encoder.cache_clear()
    op2.counter.cache_clear()


def test_query_reads_texts_in_short_batches(spark, library, tmp_path):
    """With 4,096 texts decoded at once executors' heaps grew to a gigabyte; rows are the same in short batches."""
    rows_at_once = "spark.sql.parquet.columnarReaderBatchSize"
    texts = [None, "", *(f"text {i} there" for i in range(1025))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    try:
        spark.conf.unset(rows_at_once)
        got = op1.query(spark, str(tmp_path)).select("doc_id", "ids").collect()
        assert spark.conf.get(rows_at_once) == "512"
        assert sorted((r.doc_id, r.ids) for r in got) == [(i, library.encode(t or "")) for i, t in enumerate(texts)]
        spark.conf.set(rows_at_once, "100")
        op1.query(spark, str(tmp_path))
        assert spark.conf.get(rows_at_once) == "100"
    finally:
        spark.conf.unset(rows_at_once)
