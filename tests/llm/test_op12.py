"""Languages of texts: parts against plain versions, accuracy on the fold that training never sees."""

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import op12_language as language

DIR = "/root/testdata/sf0.01"
TEXTS = {
    "en": "the and with this that thing was of to inging erthly would have been there",
    "fr": "le la les des queue éauxtion être avec dans une françaises mentoire où",
    "el": "και το της είναι ελληνικά λέξεις με ο ή",
    "ru": "и это русские слова в тексте на языке",
}


def model_of(texts: dict, penalty: float = 3.0) -> language.LanguageModel:
    counts = np.zeros((len(texts), language.CELLS + len(language.NAMES)), np.int64)
    for k, t in enumerate(texts.values()):
        words = language.words_of(t)
        language._add_counts(counts[k], words, np.ones(len(words), np.int64))
    return language.LanguageModel(list(texts), counts, penalty)


def plain_best(scores, penalty):
    """All sequences of a short text; of equals in sum any is right."""
    n, k = scores.shape
    return max((sum(scores[i, x] for i, x in enumerate(way)) - penalty * sum(a != b for a, b in itertools.pairwise(way)), way) for way in itertools.product(range(k), repeat=n))


def test_best_sequence_against_all_sequences():
    r = np.random.default_rng(3)
    sizes = np.array([0, 5, 1, 6, 0, 3])
    scores = r.integers(-6, 6, (int(sizes.sum()), 3)).astype(np.float32)
    for penalty in (0, 2, 5, 100):
        label, at = language.best_sequence(scores, sizes, penalty), 0
        for n in sizes:
            own, ways = scores[at : at + n], label[at : at + n]
            got = own[np.arange(n), ways].sum() - penalty * (np.diff(ways) != 0).sum()
            assert n == 0 or got == plain_best(own, penalty)[0]
            at += n


def test_shortcuts_change_nothing():
    r = np.random.default_rng(5)
    settled = 0
    for _ in range(300):
        # one language leads in most words, or in a stretch
        scores = r.normal(size=(int(r.integers(1, 40)), 4)).astype(np.float32)
        scores[:, 2] += r.choice([0, 1.5, 3])
        a = int(r.integers(0, len(scores)))
        scores[a : a + int(r.integers(0, 9)), 1] += r.choice([0, 4])
        for penalty in (1.0, 4.0):
            one = language.single_language(scores, penalty)
            full = language.viterbi(scores, np.array([len(scores)]), penalty)
            settled += one is not None
            assert one is None or (full == one).all()
    assert 100 < settled < 500
    for text in ("plain ASCII", "Été où ÿ ß ʯ", "a²b µ ½ x_1", "ªº", "λ a", "dash – “q” €", "x̄"):
        assert language.words_of(text) == language._word_pattern().findall(text)


def test_grams_against_slices():
    words = ["a", "Été", "日本語", "x" * 40]
    cells, owner = language.grams(words)
    for k, w in enumerate(words):
        marked = f" {w.lower()} "
        assert (owner == k).sum() == len(w) + (len(w) + 1) + len(w)
        one = language.grams([w])[0]
        assert sorted(one) == sorted(cells[owner == k])
        assert len(marked) == len(w) + 2
    assert len({*language.grams(["abc"])[0]} & {*language.grams(["abd"])[0]}) >= 5  # all grams without the third letter


def test_words_and_scripts():
    assert language.words_of("Don't l'été 12ab_c μικρό日本гос½ x̄y") == ["Don", "t", "l", "été", "ab", "c", "μικρό", "日本", "гос", "½", "x̄y"]
    assert language.letters_in(["½", "x̄y", "ab"]).tolist() == [0, 2, 2]
    names = [language.NAMES[k] for k in language.scripts_of(np.array([ord(c) for c in "aßωжאلहก한ひ漢ᚠ"]))]
    assert names == ["latin", "latin", "greek", "cyrillic", "hebrew", "arabic", "devanagari", "thai", "hangul", "kana", "han", "other"]
    assert max(map(len, language.words_of("漢" * 100))) == language.LONGEST


def test_spans_of_mixed_texts():
    m = model_of(TEXTS)
    text = "this thing was there, être avec les françaises! λέξεις это слова 123"
    spans = m.spans([text, "", "12 ½ !"])
    assert [x[2] for x in spans[0]] == ["en", "fr", "el", "ru"]
    assert text[spans[0][1][0] : spans[0][1][1]] == "être avec les françaises"
    assert spans[1:] == [[], []]
    # a dear change keeps neighbours of one script together, never across scripts
    dear = model_of(TEXTS, 1000.0)
    assert [x[2] for x in dear.spans([text])[0]][1:] == ["el", "ru"]
    assert m.predict(["", "12 ½ !"]) == [("und", 0.0)] * 2
    lang, score = m.predict([TEXTS["ru"]])[0]
    assert lang == "ru" and 0.9 < score <= 1
    # a text alone and beside others
    some = [text, TEXTS["fr"], "x", text * 50]
    assert m.predict(some) == [m.predict([t])[0] for t in some]


def test_rows(spark, docs_with_odd_rows):
    m = language.fit(docs_with_odd_rows)
    assert m.languages == ["en"]
    out = language.with_language(docs_with_odd_rows.withColumn("score", F.lit("old")), m).collect()
    assert len(out) == docs_with_odd_rows.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) if not any(map(str.isalpha, r.text or "")) else r.lang_pred == "en" and 0 <= r.score <= 1 for r in out)
    empty = docs_with_odd_rows.limit(0)
    assert language.with_language(empty, m).collect() == []
    assert language.language_spans(empty, m).collect() == []
    nothing = language.fit(empty)
    assert {r.lang_pred for r in language.with_language(docs_with_odd_rows, nothing).collect()} == {"und"}
    no_letters = language.fit(spark.createDataFrame([("1 2", "xx"), (None, "yy"), ("ab", "zz")], "text string, lang string"))
    assert no_letters.languages == ["xx", "yy", "zz"]
    spans = language.language_spans(docs_with_odd_rows.where("doc_id in (0, 100)"), m).collect()
    assert {(r.doc_id, r.lang) for r in spans} == {(0, "en")}


def test_counts_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(120)
    a = language.fit(docs.repartition(1))
    b = language.fit(docs.repartition(7))
    assert a.languages == b.languages and (a.logs == b.logs).all() and (a.fits == b.fits).all()


@pytest.fixture(scope="module")
def predicted(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "lang", "text")
    return language.query(spark, DIR).join(docs, "doc_id").collect()


def test_accuracy_on_held_out_documents(predicted):
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in predicted)
    fresh = [r.lang == r.lang_pred for r in predicted if r.held_out]
    assert len(fresh) > 250 and sum(fresh) / len(fresh) >= 0.98
