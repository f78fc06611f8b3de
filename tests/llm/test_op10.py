import random
import re

import numpy as np
import pytest

from weftgraph.llm import op10_jaccard as jaccard
from weftgraph.llm.components import components


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    best = [k for k in range(len(rows))]

    def root(i):
        while best[i] != i:
            i = best[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= 75 * len(sets[i] | sets[j]):
                best[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted((d, len(sets[i]), ids[root(i)]) for i, (d, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 6)))
    passages = [[word() for _ in range(55)] for _ in range(2)]
    rows, d = [], 0
    for size in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 12, 15, 20, 30, 40, 60, 100, 250, 700]:
        base = [word() for _ in range(size)]
        for _ in range(7):
            w = list(base)
            for _ in range(r.randint(0, 1 + size // 25)):
                k = r.randrange(len(w) + 1)
                w[k : k + r.randint(0, 1 + size // 12)] = [word() for _ in range(r.randint(0, 1 + size // 12))]
            rows.append((d := d + r.randint(1, 5), "  ".join(w).title() if r.random() < 0.2 else " ".join(w)))
    for k in range(40):
        own = [word() for _ in range(r.choice([5, 10, 14, 18, 22, 60, 200]))]
        p = passages[k % 2]
        rows.append((d := d + 1, " ".join(own[: len(own) // 2] + p + own[len(own) // 2 :])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,small", [(1, 12), (2, 3), (3, 2)])
def test_against_brute_force(spark, monkeypatch, seed, small):
    monkeypatch.setattr(jaccard, "SMALL", small)
    rows = corpus(seed)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute(rows)


def test_signatures_miss_no_pair():
    """Random similar sets of every size, at the edge of similarity."""
    r = np.random.default_rng(5)
    for _ in range(1500):
        n = int(r.integers(1, 120))
        a = r.integers(0, 1 << 63, n, dtype=np.uint64)
        most = 2 * n - 2 * -(-75 * 2 * n // 175)
        drop = int(r.integers(0, most // 2 + 1))
        b = np.concatenate([a[drop:], r.integers(0, 1 << 63, int(r.integers(0, most // 2 + 1)), dtype=np.uint64)])
        a, b = np.unique(a), np.unique(b)
        shared = len(np.intersect1d(a, b))
        if not shared or 100 * shared < 75 * (len(a) + len(b) - shared):
            continue
        doc, sig = jaccard.signatures(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2, int(n % 2))
        assert np.intersect1d(sig[doc == 0], sig[doc == 1]).size


def test_odd_rows(spark, docs_with_odd_rows):
    rows = [(r.doc_id, r.text) for r in docs_with_odd_rows.collect()]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_groups(docs_with_odd_rows).collect())
    assert got == brute(rows)
    assert jaccard.similar_groups(docs_with_odd_rows.limit(0)).collect() == []
    twice = spark.createDataFrame([(1, "a b c d e f"), (1, "x y z"), (None, "a b c d e f"), (None, "q r"), (3, "X  Y Z")], "doc_id long, text string")
    assert sorted(((r.doc_id or 0), r.n_shingles, r.component_id or 0) for r in jaccard.similar_groups(twice).collect()) == [(0, 1, 0), (0, 2, 1), (1, 1, 1), (1, 2, 1), (3, 1, 1)]


def test_components(spark):
    r = random.Random(1)
    pairs = [(k, k + 1) for k in range(100, 200)] + [(r.randrange(1000, 1400), r.randrange(1000, 1400)) for _ in range(250)] + [(7, 7)]
    best = {}
    root = lambda x: x if best.setdefault(x, x) == x else root(best[x])
    for a, b in pairs:
        if a != b:
            best[max(root(a), root(b))] = min(root(a), root(b))
    got = {n.node: n.component for n in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {x: root(x) for x in best}


@pytest.mark.parametrize("seed,small,block,edits", [(4, 2, 512, 3), (5, 12, 16, 6), (6, 3, 8, 16)])
def test_numbers_of_links(spark, monkeypatch, seed, small, block, edits):
    """Near copies of one text, more than a small group holds, meet all their partners, in whatever blocks."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    r = random.Random(seed)
    base = [f"w{k}" for k in range(160)]
    rows = corpus(seed)
    for d in range(10000, 10120):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        rows += [(d, " ".join(w[: len(w) - r.randint(0, 20)]))] * r.choice([1, 1, 2])
    sets = {d: frozenset(shingles(t)) for d, t in rows}
    want = {x: sum(x != y and bool(x & y) and 100 * len(x & y) >= 75 * len(x | y) for y in set(sets.values())) for x in set(sets.values())}
    got = {g.doc_id: g.n_links for g in jaccard.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: want[x] if x else 0 for d, x in sets.items()}


def test_shared_counts():
    r = np.random.default_rng(7)
    sides = [[np.unique(r.integers(0, 500, int(r.integers(1, 200)))).astype(np.uint64) for _ in range(n)] for n in (9, 14)]
    got = jaccard.shared_counts([np.array([len(x) for x in s]) for s in sides], [np.concatenate(s) for s in sides])
    assert got.tolist() == [[len(np.intersect1d(x, y)) for y in sides[1]] for x in sides[0]]


def test_components_take_few_rounds(spark, monkeypatch):
    """What fits one task is finished there; larger tables, and earlier components with new links, give the same."""
    from weftgraph.llm import components as parts

    r = random.Random(8)
    pairs = [(i, i + 1) for i in range(300)] + [(r.randrange(400, 900), r.randrange(400, 900)) for _ in range(260)]
    links = spark.createDataFrame(pairs, "a long, b long")
    rounds = []
    monkeypatch.setattr(parts, "stored", lambda *a, f=parts.stored, **k: (rounds.append(1), f(*a, **k))[1])
    got = sorted(tuple(x) for x in parts.components(links).collect())
    assert len(rounds) == 2
    monkeypatch.setattr(parts, "AT_ONCE", 0)
    assert sorted(tuple(x) for x in parts.components(links).collect()) == got
    first = parts.components(links.limit(200))
    assert sorted(tuple(x) for x in parts.components(first.toDF("a", "b").unionByName(links)).collect()) == got
