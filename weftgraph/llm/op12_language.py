"""Language identification with spans of mixed-language text.

Words are runs of letters of one script, so script ranges say which languages a word can be of. A word's
score in a language is the log-likelihood of its 1- to 3-grams, from counts over all labelled training
texts, in a table of fixed size. Over a text's words, the best sequence of languages is found by the
Viterbi algorithm, where a change of language costs a penalty; its runs are the spans, and the language
with the most letters is the text's.

Tasks count the grams of their own texts, Spark sums the counts, and what comes to the driver is one
table of 2**BITS cells a language. Predicting shuffles nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import chunks, free_names, kind_of, mapped, schema_of, table

BITS, ORDERS = 16, (1, 2, 3)
CELLS = 1 << BITS
#: Added to each count; the share of a language's letters that makes a script one of its own.
SMOOTHING, OWN_SHARE = 0.25, 0.02
#: What a change of language costs, in the unit of scores: the log-likelihood of a word's grams over the number of orders.
PENALTY = 6.0
#: Letters of a word at most; longer runs, as of scripts without spaces, are several words.
LONGEST = 40
#: Bytes of text turned over at once, distinct words whose grams are, and languages whose counts a task holds.
AT_ONCE, WORDS_AT_ONCE, LANGUAGES_HELD = 2 << 20, 1 << 14, 32
NO_LANGUAGE = "und"
#: Ranges of code points of scripts, marks that go on a letter among them. Letters outside of all are one script more.
SCRIPTS = {
    "latin": "A-Za-zªºÀ-ÖØ-öø-ʸ̀-ͯᴀ-ᴥḀ-ỿⱠ-ⱿꜢ-ꟿﬀ-ﬆＡ-Ｚａ-ｚ",
    "greek": "Ͱ-Ͽἀ-῿",
    "cyrillic": "Ѐ-ԯᲀ-ᲈⷠ-ⷿꙀ-ꚟ",
    "armenian": "Ա-ևﬓ-ﬗ",
    "hebrew": "֑-״יִ-ﭏ",
    "arabic": "ؐ-ؚؠ-ٟٮ-ۓە-ۜۮ-ۿݐ-ݿࢠ-ࣿﭐ-﷿ﹰ-ﻼ",
    "devanagari": "ऀ-ॣॱ-ॿ꣠-ꣿ",
    "bengali": "ঀ-ৣৰৱ",
    "gurmukhi": "ਁ-ਫ਼ੰ-ੵ",
    "gujarati": "ઁ-ૣ",
    "tamil": "ஂ-௥",
    "telugu": "ఀ-ౣ",
    "kannada": "ಀ-ೣ",
    "malayalam": "ഀ-ൣ",
    "sinhala": "ඁ-ෳ",
    "thai": "ก-ฺเ-๎",
    "lao": "ກ-ຽເ-ໍ",
    "tibetan": "ༀཀ-ྼ",
    "myanmar": "က-ဿၐ-ႏ",
    "georgian": "Ⴀ-ჿᲐ-Ჿⴀ-ⴭ",
    "ethiopic": "ሀ-፟ᎀ-᎟",
    "khmer": "ក-៓",
    "hangul": "ᄀ-ᇿㄱ-ㆎ가-힣",
    "kana": "ぁ-ゟァ-ヺー-ヿㇰ-ㇿｦ-ﾟ",
    "han": "々-〇㐀-䶿一-鿿豈-﫿\U00020000-\U0003134f",
}
NAMES = [*SCRIPTS, "other"]


@lru_cache(maxsize=1)
def _word_pattern() -> re.Pattern:
    return re.compile("|".join([*(f"[{r}]{{1,{LONGEST}}}" for r in SCRIPTS.values()), rf"[^\W\d_]{{1,{LONGEST}}}"]))


@lru_cache(maxsize=1)
def _ranges() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, script) of all ranges by their first code point."""
    out = []
    for k, text in enumerate(SCRIPTS.values()):
        for a, z in re.findall("(?s)(.)(?:-(.))?", text):
            out.append((ord(a), ord(z or a), k))
    return tuple(np.array(c) for c in zip(*sorted(out), strict=True))


def scripts_of(letters: np.ndarray) -> np.ndarray:
    """The script of each code point, as a place in NAMES."""
    first, last, script = _ranges()
    at = np.maximum(np.searchsorted(first, letters, "right") - 1, 0)
    return np.where((letters >= first[at]) & (letters <= last[at]), script[at], len(NAMES) - 1)


@lru_cache(maxsize=1)
def _latin_only() -> tuple[re.Pattern, re.Pattern]:
    """(what texts don't have whose letters are all of the Latin ranges, the words of such texts)."""
    return re.compile("[^\x00-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf-ʯ‐-⁄]"), re.compile(f"[A-Za-zÀ-ÖØ-öø-ʯ]{{1,{LONGEST}}}")


def words_of(text: str) -> list[str]:
    """Runs of letters and marks of one script, of LONGEST at most, as they are written."""
    more, latin = _latin_only()
    return _word_pattern().findall(text) if more.search(text) else latin.findall(text)


def letters_in(words: list[str]) -> np.ndarray:
    return np.array([len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in words], np.int64)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(cell, word) of every 1-, 2- and 3-gram of the words in lower case, with a mark at both ends; words in order."""
    cells, owner = [], []
    code = np.frombuffer(" ".join(["", *words, ""]).lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    edge = code == 32
    word = np.cumsum(edge) - 1
    for n in ORDERS:
        h = np.full(len(code) - n + 1, n, np.uint64)
        inside = np.ones(len(h), bool)
        for k in range(n):
            part = slice(k, len(code) - n + 1 + k)
            h = (h * np.uint64(0x100000001B3)) ^ code[part]
            if n == 1 or 0 < k < n - 1:
                inside &= ~edge[part]
        inside &= word[: len(h)] < len(words)
        cells.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS))[inside])
        owner.append(word[: len(h)][inside])
    cells, owner = np.concatenate(cells), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return cells[order].astype(np.int64), owner[order]


class LanguageModel:
    """counts: languages x (cells, then letters of each script), from training texts."""

    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float = PENALTY):
        order = sorted(range(len(languages)), key=lambda k: languages[k])  # by code point, which settles ties
        self.languages, self.penalty = [languages[k] for k in order], penalty
        counts = counts[order].astype(np.float64).reshape(len(order), CELLS + len(NAMES))
        cells, letters = counts[:, :CELLS] + SMOOTHING, counts[:, CELLS:]
        self.logs = (np.log(cells / cells.sum(axis=1, keepdims=True)).T / len(ORDERS)).astype(np.float32)
        own = letters >= OWN_SHARE * np.maximum(letters.sum(axis=1, keepdims=True), 1)
        self.fits = np.where(own.any(axis=0), own, True).T  # script x language; all of them where none has the script

    def word_scores(self, words: list[str]) -> np.ndarray:
        """words x languages; a language that can't have a word's script is out of the question."""
        out = np.zeros((len(words), len(self.languages)), np.float32)
        for a in range(0, len(words), WORDS_AT_ONCE):
            some = words[a : a + WORDS_AT_ONCE]
            cells, owner = grams(some)
            at = np.flatnonzero(np.diff(owner, prepend=-1))
            out[a + owner[at]] = np.add.reduceat(self.logs[cells], at, axis=0)
        first = np.frombuffer("".join(w[0] for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        return np.where(self.fits[scripts_of(first)], out, np.float32(-1e6))

    def labelled(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray, np.ndarray]:
        """(words of each text; letters, scores and language of each word, the texts' words in a row)."""
        split = [words_of(t) for t in texts]
        row = list(chain.from_iterable(split))
        known = list(dict.fromkeys(row))
        ids = dict(zip(known, range(len(known)), strict=True))
        flat = np.fromiter(map(ids.__getitem__, row), np.int64, len(row))
        letters = letters_in(known)
        # runs of marks alone say nothing
        scores = np.where(letters[:, None] > 0, self.word_scores(known), np.float32(0)) if known else np.zeros((0, len(self.languages)), np.float32)
        scores = scores[flat]
        return split, letters[flat], scores, best_sequence(scores, np.array([len(w) for w in split], np.int64), self.penalty)

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """Of each text its language and how sure that is: the share of letters in spans of it, times its likelihood against the others on these."""
        if not self.languages:
            return [(NO_LANGUAGE, 0.0)] * len(texts)
        split, letters, scores, label = self.labelled(texts)
        out, at = [], 0
        for words in split:
            own = slice(at, at + len(words))
            at += len(words)
            by = np.bincount(label[own], weights=letters[own], minlength=len(self.languages))
            if not by.sum():
                out.append((NO_LANGUAGE, 0.0))
                continue
            k = int(by.argmax())
            total = scores[own][label[own] == k].sum(axis=0, dtype=np.float64)
            sure = 1 / np.exp(np.minimum(total - total[k], 50)).sum()
            out.append((self.languages[k], float(by[k] / by.sum() * sure)))
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """Of each text its spans (start, end, language) of code points: from the first of some words of a language to the end of their last."""
        if not self.languages:
            return [[] for _ in texts]
        split, letters, _, label = self.labelled(texts)
        out, at = [], 0
        for text, words in zip(texts, split, strict=True):
            found: list[list] = []
            for m, n, k in zip(_word_pattern().finditer(text), letters[at : at + len(words)], label[at : at + len(words)], strict=True):
                if not n:
                    continue
                if found and found[-1][2] == self.languages[k]:
                    found[-1][1] = m.end()
                else:
                    found.append([m.start(), m.end(), self.languages[k]])
            at += len(words)
            out.append([tuple(x) for x in found])
        return out


def best_sequence(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each row of scores, given that texts of these sizes follow each other there and a change costs penalty.

    Texts for which no change can pay are settled at once. All others go forward word by word at the same time, the
    longest first. Of equals the first language holds, and staying.
    """
    label = np.zeros(len(scores), np.int64)
    if not scores.size:
        return label
    ends, left = np.cumsum(sizes), []
    for k, (a, z) in enumerate(zip((ends - sizes).tolist(), ends.tolist(), strict=True)):
        one = single_language(scores[a:z], penalty)
        if one is None:
            left.append(k)
        else:
            label[a:z] = one
    if left:
        rows = np.concatenate([np.arange(ends[k] - sizes[k], ends[k]) for k in left])
        label[rows] = viterbi(scores[rows], sizes[left], penalty)
    return label


def single_language(scores: np.ndarray, penalty: float) -> int | None:
    """The language of all words of a text, if any way with a change is worse: no stretch gains as much in others as its changes cost."""
    if not len(scores):
        return 0
    k = int(scores.sum(axis=0, dtype=np.float64).argmax())
    if scores.shape[1] == 1:
        return k
    gain = scores - scores[:, k : k + 1]
    gain[:, k] = -np.inf
    run = np.cumsum(gain.max(axis=1), dtype=np.float64)
    low = np.minimum.accumulate(np.append(0.0, run[:-1]))
    # two changes around a stretch, one if it reaches an end, none if it is the whole text
    settled = (run - low).max() < 2 * penalty and run.max() < penalty and run[-1] - low.min() < penalty and run[-1] < 0
    return k if settled else None


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """best_sequence, of texts of a word or more, by going through all of them."""
    label = np.zeros(len(scores), np.int64)
    order = np.argsort(-sizes, kind="stable")
    start = (np.cumsum(sizes) - sizes)[order]
    open_ = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(int(sizes.max())), "right")  # texts longer than t
    value = np.zeros((len(sizes), scores.shape[1]))
    stay = np.empty(scores.shape, bool)
    source = np.empty(len(scores), np.int16)
    for t, k in enumerate(open_.tolist()):
        at, v = start[:k] + t, value[:k]
        source[at] = v.argmax(axis=1)
        change = v.max(axis=1, keepdims=True) - (penalty if t else 0)
        stay[at] = v >= change
        value[:k] = np.maximum(v, change) + scores[at]
    now = value.argmax(axis=1)
    for t in range(len(open_) - 1, -1, -1):
        k = int(open_[t])
        at, own = start[:k] + t, now[:k]
        label[at] = own
        now[:k] = np.where(stay[at, own], own, source[at])
    return label


def held_out(key: str | Column = "doc_id") -> Column:
    """Whether a row belongs to the fold that training never sees; null ids don't."""
    return F.coalesce(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _counted(batches: Iterator, text: str, lang: str) -> Iterator:
    """(lang, cell, n) of the texts of a task; cells from CELLS on count letters by script."""
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator:
        for language, counts in held.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at])], names=["lang", "cell", "n"])
        held.clear()

    for batch in batches:
        texts, languages = batch.column(text).to_pylist(), batch.column(lang).to_pylist()
        for a, z in chunks([len(t or "") for t in texts], AT_ONCE):
            words: dict[str, Counter] = {}
            for t, language in zip(texts[a:z], languages[a:z], strict=True):
                words.setdefault(language, Counter()).update(words_of(t or ""))
            for language, found in words.items():
                if language not in held:
                    if len(held) >= LANGUAGES_HELD:
                        yield from flush()
                    held[language] = np.zeros(CELLS + len(NAMES), np.int64)
                _add_counts(held[language], list(found), np.fromiter(found.values(), np.int64))
    yield from flush()


def _add_counts(counts: np.ndarray, words: list[str], times: np.ndarray) -> None:
    for a in range(0, len(words), WORDS_AT_ONCE):
        some, n = words[a : a + WORDS_AT_ONCE], times[a : a + WORDS_AT_ONCE]
        cells, owner = grams(some)
        counts[:CELLS] += np.bincount(cells, weights=n[owner], minlength=CELLS).astype(np.int64)
        first = np.frombuffer("".join(w[0] for w in some).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        counts[CELLS:] += np.bincount(scripts_of(first), weights=letters_in(some) * n, minlength=len(NAMES)).astype(np.int64)


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", penalty: float = PENALTY) -> LanguageModel:
    """Learn from all rows of docs whose lang isn't null; null texts add nothing but their language's name.

    Repeated rows count as often as they come. With no such row there is no language, and every text's is und.
    """
    q = lambda c: F.col(f"`{c}`")
    rows = docs.where(q(lang).isNotNull()).select(q(text).alias("text"), q(lang).alias("lang"))
    counts = mapped(rows, partial(_counted, text="text", lang="lang"), "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n"))
    found = counts.toArrow()  # a table of fixed size for each language
    names, place = np.unique(found.column("lang").to_numpy(zero_copy_only=False).astype(str), return_inverse=True)
    empty = sorted({r.lang for r in rows.select("lang").distinct().collect()} - set(names.tolist()))  # languages without any letter in their texts
    out = np.zeros((len(names) + len(empty), CELLS + len(NAMES)), np.int64)
    out[place, found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return LanguageModel([*names.tolist(), *empty], out, penalty)


def _predicted(batches: Iterator, model: LanguageModel, text: str, names: tuple[str, str]) -> Iterator:
    for batch in batches:
        texts = batch.column(text).to_pylist()
        got: list[tuple[str, float]] = []
        for a, z in chunks([len(t or "") for t in texts], AT_ONCE):
            got += model.predict([t or "" for t in texts[a:z]])
        kept = [k for k, n in enumerate(batch.schema.names) if n != text]
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in kept), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*(batch.schema.names[k] for k in kept), *names])


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", out: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with each whole text's language and a score from 0 to 1, in the columns out and score, which replace such columns.

    und and 0 for null texts and texts without a letter (or if nothing was learned). Of equals the language first by code
    point. Rows alike in text get alike results, whatever else is in their batch; an empty table gives no rows.
    """
    q = lambda c: F.col(f"`{c}`")
    keep = [c for c in docs.columns if c not in (out, score)]
    (copy,) = free_names(docs, "__text")
    made = mapped(docs.select(*map(q, keep), q(text).alias(copy)), partial(_predicted, model=model, text=copy, names=(out, score)), schema_of(docs, keep, f"`{out}` string, `{score}` double"))
    return made


def _spanned(batches: Iterator, model: LanguageModel, text: str) -> Iterator:
    for batch in batches:
        texts = batch.column(text).to_pylist()
        for a, z in chunks([len(t or "") for t in texts], AT_ONCE):
            found = model.spans([t or "" for t in texts[a:z]])
            at = [k for k, s in enumerate(found) for _ in s]
            flat = [x for s in found for x in s]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, z - a).take(pa.array(at, pa.int64())), *(pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.string())))], names=[batch.schema.names[0], "start", "end", "lang"])


def language_spans(docs: DataFrame, model: LanguageModel, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, start, end, lang): the runs of words of one language in each text, in code points, end exclusive; texts without a letter have none."""
    q = lambda c: F.col(f"`{c}`")
    return mapped(docs.select(q(key), q(text).alias("__text")), partial(_spanned, model=model, text="__text"), f"`{key}` {kind_of(docs, key)}, start long, end long, lang string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
