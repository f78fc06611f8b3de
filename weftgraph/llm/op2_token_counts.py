"""Token counts by prefix dynamic programming.

For each distinct word the count of every prefix is kept (piece_lattice: each prefix has one exact
state, whose count is that of the state before its last piece plus one). As no piece reaches over
a word's mark, the counts of a text's prefixes are those of its words added up; questions about
truncation and budgets are looked up in them without encoding again. No step shuffles.
"""

from __future__ import annotations

from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm.common import chunks, keeps, kind_of, mapped, table
from weftgraph.llm.op1_sentencepiece import default_model
from weftgraph.llm.piece_lattice import ALONE_BYTES, MARK, PieceModel, PrefixStates, WordCache, marked_words

LIMIT = 4096


def _prefix_counts(states: PrefixStates) -> tuple[int, str, bytes]:
    """The word's count, and the type and counts of each prefix from one character on; a prefix may have more tokens than the word."""
    made = states.count
    if len(made) <= 64 or max(made) < 256:  # a character has four units at most
        return made[-1], "u1", bytes(made[1:].tolist())
    return made[-1], "<u4", np.array(made[1:], dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def counter(path: str) -> WordCache:
    keeps(__name__, counter.cache_clear)
    model = PieceModel.load(path)
    return WordCache(model, _prefix_counts, lambda v: len(v[2]) + 90, ALONE_BYTES)


def _words(text: str, model: PieceModel) -> list[str]:
    if model.splits_at_mark:
        return marked_words(text)
    return [MARK + text.replace(" ", MARK)] if text else []


def prefix_counts(text: str, cache: WordCache) -> np.ndarray:
    """Exact token counts of text[:0], text[:1], ... text[:len(text)]."""
    words = _words(text, cache.model)
    known = cache.fill(set(words))
    out, total = [np.zeros(1, dtype=np.int64)], 0
    for k, w in enumerate(words):
        n, kind, packed = known[w]
        own = np.frombuffer(packed, dtype=kind).astype(np.int64) + total
        out.append(own[1:] if k == 0 else own)  # the first mark is not in the text
        total += n
    return np.concatenate(out)


def chars_within(text: str, budget: int, cache: WordCache) -> int:
    """The length of the longest prefix that has at most budget tokens.

    Counts only grow from word to word, so the answer is in the last word that can begin within the budget,
    or, where none of its prefixes is short enough, in the one before.
    """
    words = _words(text, cache.model)
    known = cache.fill(set(words))
    begun, chars, total = [], 0, 0
    for k, w in enumerate(words):
        if total >= budget:
            break
        begun.append((w, chars, total))
        chars += len(w) - (k == 0)  # the first mark is not in the text
        total += known[w][0]
    for k in range(len(begun) - 1, -1, -1):
        w, chars, total = begun[k]
        _, kind, packed = known[w]
        good = np.flatnonzero(np.frombuffer(packed, dtype=kind) <= budget - total)
        if len(good):
            return chars + int(good[-1]) + (k > 0)
    return 0


def _count_batches(batches, path: str, limit: int, key: str, text: str):
    cache = counter(path)
    for batch in batches:
        col = batch.column(text)
        texts = [t or "" for t in col.to_pylist()]
        for a, b in chunks([len(t) for t in texts]):
            words = [_words(t, cache.model) for t in texts[a:b]]
            known = cache.fill(set().union(*words))
            totals = [sum([known[w][0] for w in ws]) for ws in words]
            within = [len(t) if n <= limit else chars_within(t, limit, cache) for t, n in zip(texts[a:b], totals)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).slice(a, b - a),
                    pa.array([len(t.encode()) for t in texts[a:b]], pa.int64()),
                    pa.array(totals, pa.int64()),
                    pa.array([n > limit for n in totals], pa.bool_()),
                    pa.array(within, pa.int64()),
                ],
                names=[key, "n_bytes", "n_tokens", "over_limit", "chars_within_limit"],
            )


def token_counts(docs: DataFrame, limit: int = LIMIT, model_path: str | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: bytes, exact tokens, whether these are more than limit, and the characters of the longest prefix within it.

    Null and empty texts have 0 bytes and tokens. Repeated rows each give a row; other columns are left out.
    """
    run = partial(_count_batches, path=model_path or default_model(), limit=limit, key=key, text=text)
    return mapped(docs.select(key, text), run, f"`{key}` {kind_of(docs, key)}, n_bytes long, n_tokens long, over_limit boolean, chars_within_limit long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
