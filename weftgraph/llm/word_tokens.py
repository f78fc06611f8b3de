"""Ids of a tokenizers file, with the library asked once for each distinct part of a word.

White space always separates this file's tokens, so a text's ids are those of its words in turn. A
word of ASCII and Latin-1 letters is lower-cased and cut where the file's own pattern cuts (runs
of letters, single digits, the rest); a run of letters is one unit to the library's model, which
encodes it directly. A text of just such words is cut in one go. Every other word goes to the
library's whole encoder as it is.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

from weftgraph.llm.common import keeps

CACHE_WORDS = 500_000
CACHE_PARTS = 400_000
PLAIN = re.compile(r"[\x21-\x26\x28-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]+")
PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9 \n]+")
#: What texts don't have whose words are all plain.
NOT_PLAIN = re.compile(r"[^\n\x20-\x26\x28-\x3b\x3d-\x7eÀ-ÖØ-öø-ÿ]")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
#: White space besides spaces and line feeds, which words are not cut at.
OTHER_SPACE = re.compile(r"[^\S \n]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return [chr(b) if b in plain else chr(0x100 + sum(x not in plain for x in range(b))) for b in range(256)]


class WordTokens:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.letters = byte_letters()
        self.words: dict[str, bytes] = {}
        self.parts = _Parts(self)

    def _ids(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def _plain(self, text: str) -> bytes:
        if len(self.parts) > CACHE_PARTS:
            self.parts.clear()
        return b"".join(map(self.parts.__getitem__, PARTS.findall(text.lower())))

    def _word(self, word: str) -> bytes:
        return self._plain(word) if PLAIN.fullmatch(word) else self._ids(word)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        return [self._by_words(t) if NOT_PLAIN.search(t) else self._plain(t) for t in texts]

    def _by_words(self, text: str) -> bytes:
        words, known = re.split("[ \n]", text) if OTHER_SPACE.search(text) else text.split(), self.words
        if len(known) + len(words) > CACHE_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))


class _Parts(dict):
    """Ids of parts of words, found when first asked for."""

    def __init__(self, tokens: WordTokens):
        self.tokens = tokens

    def __missing__(self, part: str) -> bytes:
        if LETTERS.fullmatch(part):
            plain = part if part.isascii() else "".join([self.tokens.letters[b] for b in part.encode()])
            ids = array("I", [t.id for t in self.tokens.model.tokenize(plain)]).tobytes()
        else:
            ids = self.tokens._ids(part)
        self[part] = ids
        return ids


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    keeps(__name__, word_tokens.cache_clear)
    return WordTokens(path)
