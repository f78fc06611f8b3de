"""A forward pass over SentencePiece words that keeps one state for every prefix.

A prefix's state is the last piece of the prefix's own encoding and where that piece begins, so
states of a common prefix hold for every word with that prefix. In a unigram model the state is
the best score's (plain Viterbi). In a BPE model a piece may follow another only if merging the
two strings together gives these same two pieces; exactly one chain of such pieces spans each
prefix, and it is what the library's merging gives, so scores need no comparison.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable

MARK = "▁"
#: Ids from here on stand for single characters that are not in the vocabulary.
FOREIGN = 1 << 21
#: Bytes of words and values that a worker keeps, and of each beside its letters.
CACHE_BYTES, ENTRY_BYTES = 40 << 20, 160
#: As CACHE_BYTES, where no other operator's stages share the executor.
ALONE_BYTES = 120 << 20
CACHE_PAIRS = 300_000


class PieceModel:
    """Vocabulary of a .model file, read through the sentencepiece package."""

    def __init__(self, pieces: list[tuple[str, float, str]], kind: str, byte_fallback: bool):
        """pieces: (text, score, one of normal/byte/control/unknown/unused) by id; kind: bpe or unigram."""
        if kind not in ("bpe", "unigram"):
            raise ValueError(f"a {kind} model has no merge order or scores to search")
        self.kind, self.byte_fallback = kind, byte_fallback
        self.texts = [t for t, _, _ in pieces]
        self.ids = {t: i for i, (t, _, what) in enumerate(pieces) if what == "normal"}
        self.scores = [s for _, s, _ in pieces]
        self.unknown = next((i for i, x in enumerate(pieces) if x[2] == "unknown"), 0)
        self.byte_ids = {int(t[3:5], 16): i for i, (t, _, what) in enumerate(pieces) if what == "byte"}
        self.byte_values = {i: b for b, i in self.byte_ids.items()}
        self.silent = {i for i, x in enumerate(pieces) if x[2] in ("control",)}
        self.unknown_score = min((s for t, s, what in pieces if what == "normal"), default=0.0) - 10.0
        self.splits_at_mark = not any(re.search(f"[^{MARK}]{MARK}", t) for t in self.ids)
        self.kept_pairs = 0
        self.ends: dict = {}  # (id or -1, longer pieces, {piece before: whether it may follow}) by characters from last to first
        for t, i in self.ids.items():
            nodes, node = self.ends, None
            for c in reversed(t):
                node = nodes.setdefault(c, [-1, {}, {}])
                nodes = node[1]
            node[0] = i

    @classmethod
    def load(cls, path: str) -> PieceModel:
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            proto = pb.ModelProto.FromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only models that mark words in front and leave text as it is are supported")
        names = {1: "normal", 2: "unknown", 3: "control", 5: "unused", 6: "byte"}
        if any(p.type not in names or p.type == 5 for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        kind = {1: "unigram", 2: "bpe"}.get(proto.trainer_spec.model_type, "other")
        return cls([(p.piece, p.score, names[p.type]) for p in proto.pieces], kind, proto.trainer_spec.byte_fallback)

    def text_of(self, piece: int) -> str:
        return chr(piece - FOREIGN) if piece >= FOREIGN else self.texts[piece] if piece >= 0 else ""

    def merged(self, text: str) -> list[str]:
        """What merging gives: always the pair with the best score, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                i = ids.get(parts[k] + parts[k + 1])
                if i is not None and (best is None or scores[i] > best):
                    best, at = scores[i], k
            if at < 0:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def follows(self, a: int, b: int, seen: dict[int, bool]) -> bool:
        """Whether merging leaves the border between pieces a and b as it is; a is -1 at the start of a word."""
        ta, tb = self.text_of(a), self.text_of(b)
        found = self.merged(ta + tb) == ([ta, tb] if ta else [tb])
        self.kept_pairs += 1
        if self.kept_pairs <= CACHE_PAIRS:
            seen[a] = found
        return found

    def unit_ids(self, piece: int) -> tuple[int, ...]:
        """Ids that a state's piece stands for."""
        if piece < FOREIGN:
            return (piece,)
        c = chr(piece - FOREIGN)
        if self.byte_fallback:
            return tuple(self.byte_ids[b] for b in c.encode())
        return (self.unknown,)

    def unit_count(self, piece: int) -> int:
        return 1 if piece < FOREIGN or not self.byte_fallback else len(chr(piece - FOREIGN).encode())


class PrefixStates:
    """States of every prefix of the word last seen; words in sorted order reuse those of their common prefix.

    This is a depth-first walk of the trie of the words: the arrays are the path from its root. A state is a few
    numbers, so a word takes memory in proportion to its length; a whole encoding is found by walking back.
    """

    def __init__(self, model: PieceModel):
        self.model = model
        self.counts = {i: model.unit_count(i) for i in range(len(model.texts))}
        self.word = ""
        self.last = array("i", [-1])  # the last piece of each prefix
        self.start = array("i", [0])  # where that piece begins
        self.count = array("i", [0])  # units of the prefix's pieces
        self.score = array("d", [0.0])
        self.steps = 0

    def advance(self, word: str) -> None:
        old, common = self.word, 0
        if word.startswith(old):
            common = len(old)
        else:
            for a, b in zip(old, word):
                if a != b:
                    break
                common += 1
            for kept in (self.last, self.start, self.count, self.score):
                del kept[common + 1 :]
        self.word = word
        self.steps += len(word) - common
        if self.model.kind == "bpe":
            self._bpe(word, common)
        else:
            self._unigram(word, common)

    def pieces(self) -> list[int]:
        """Those of the whole word, in order."""
        out, i, last, start = [], len(self.last) - 1, self.last, self.start
        while i > 0:
            out.append(last[i])
            i = start[i]
        out.reverse()
        return out

    def _foreign(self, c: str) -> int:
        piece = FOREIGN + ord(c)
        if piece not in self.counts:
            self.counts[piece] = self.model.unit_count(piece)
        return piece

    def _bpe(self, word: str, common: int) -> None:
        last, start, count, ends, counts = self.last, self.start, self.count, self.model.ends, self.counts
        for i in range(common, len(word)):
            nodes, j, piece = ends, i, -1
            while j >= 0:
                node = nodes.get(word[j])
                if node is None:
                    break
                p, nodes, seen = node
                if p >= 0:
                    before = last[j]
                    ok = seen.get(before)
                    if ok or ok is None and self.model.follows(before, p, seen):
                        piece = p
                        break
                j -= 1
            if piece < 0:
                piece, j = self._foreign(word[i]), i
            last.append(piece)
            start.append(j)
            count.append(count[j] + counts[piece])

    def _unigram(self, word: str, common: int) -> None:
        model, last, score = self.model, self.last, self.score
        for i in range(common, len(word)):
            nodes, j, best = model.ends, i, None
            while j >= 0:
                node = nodes.get(word[j])
                if node is None:
                    break
                p, nodes, _ = node
                if p >= 0 and (best is None or score[j] + model.scores[p] > best[0]):
                    best = score[j] + model.scores[p], p, j
                j -= 1
            if word[i] not in model.ids and (best is None or score[i] + model.unknown_score > best[0]):
                best = score[i] + model.unknown_score, self._foreign(word[i]), i
            score.append(best[0])
            last.append(best[1])
            self.start.append(best[2])
            self.count.append(self.count[best[2]] + self.counts[best[1]])


def marked_words(text: str) -> list[str]:
    """Words of a text with their marks; no piece reaches from one into the next."""
    if not text:
        return []
    if "  " in text or MARK in text or text[0] == " " or text[-1] == " ":
        return re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", MARK + text.replace(" ", MARK))
    return (MARK + text.replace(" ", f" {MARK}")).split(" ")


class WordCache:
    """A value for each distinct word, made from its prefix states; words are gone through in sorted order."""

    def __init__(self, model: PieceModel, value: Callable[[PrefixStates], object], size: Callable[[object], int], most: int = CACHE_BYTES):
        """value: gets the states of the word's prefixes; size: about how many bytes a value has; most: bytes kept from call to call."""
        self.model, self.value, self.size, self.states = model, value, size, PrefixStates(model)
        self.words: dict[str, object] = {}
        self.held, self.most = 0, most

    def fill(self, words: set[str]) -> dict[str, object]:
        """A dict that has every one of the (marked) words; those of earlier calls stay until they are too many bytes."""
        if self.held > self.most:
            self.words.clear()
            self.held = 0
        kept, value, states, size, held = self.words, self.value, self.states, self.size, self.held
        for w in sorted(words.difference(kept)):
            states.advance(w)
            kept[w] = v = value(states)
            held += ENTRY_BYTES + len(w) + size(v)
        self.held = held
        return kept
