"""Word shingles of many texts at once, as 64-bit hashes, in numpy.

Texts are lower-cased (A-Z), cut at white space and joined with single spaces; a shingle's hash comes
from differences of prefix sums, so it costs the same however long its words are.
"""

from __future__ import annotations

import numpy as np

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
LETTERS = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    h = h.astype(np.uint64)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and its inverse for i below n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, INVERSE)):
            x = np.full(n, b)
            x[0] = 1
            _powers[k] = np.cumprod(x, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def shingle_sets(texts: list[bytes], words: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash): the distinct shingles of each text, sorted by text and hash.

    A text with fewer words has its whole sequence as one shingle; one without words has none.
    """
    parts, counts = [], []
    for t in texts:
        w = t.translate(LOWER).split()
        counts.append(len(w))
        if w:
            parts.append(b" ".join(w))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    data = np.frombuffer(b" ".join(parts), "u1")
    n_words = np.array(counts)
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(LETTERS[data] * up[: len(data)], dtype=np.uint64, out=total[1:])
    gaps = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(data))
    per_doc = np.where(n_words >= words, n_words - words + 1, np.minimum(n_words, 1))
    first_word = np.cumsum(n_words) - n_words
    doc = np.repeat(np.arange(len(texts)), per_doc)
    first = first_word[doc] + (np.arange(len(doc)) - (np.cumsum(per_doc) - per_doc)[doc])
    last = first + np.minimum(words, n_words)[doc] - 1
    h = mix((total[ends[last]] - total[starts[first]]) * down[starts[first]])
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], h[new]


def set_names(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Size and a 64-bit name of each of n texts' sets; equal sets have equal names, empty ones 0."""
    size = np.bincount(doc, minlength=n)
    total = np.zeros(n, np.uint64)
    if len(doc):
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        total[doc[first]] = np.add.reduceat(mix(h + np.uint64(0x632BE59BD9B4E019)), first)
    name = mix(total + size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)).view(np.int64)
    return size, np.where(size > 0, name, 0)
