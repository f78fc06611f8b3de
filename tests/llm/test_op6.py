import hashlib
import random

import pytest

from weftgraph.llm import op6_substrings as sub
from weftgraph.llm.suffix_array import suffix_array


def test_suffix_array():
    r = random.Random(1)
    for _ in range(3000):
        s = [r.randrange(r.choice([1, 2, 3, 26])) for _ in range(r.randint(0, 30))] * r.choice([1, 1, 3])
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])
    for s in (b"a" * 300, b"ab" * 150, b"banana" * 40, bytes(range(256)) * 2):
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


def brute(rows, length=200):
    seen = {}
    data = [(d, (t or "").encode()) for d, t in rows]
    for k, (_, x) in enumerate(data):
        for i in range(len(x) - length + 1):
            seen.setdefault(x[i : i + length], []).append((k, i))
    gone = [bytearray(len(x)) for _, x in data]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                gone[k][i : i + length] = b"\1" * length
    out = []
    for (d, x), g in zip(data, gone):
        runs = sum(1 for i in range(len(g)) if g[i] and (i == 0 or not g[i - 1]))
        out.append((d, len(x), sum(g), runs, hashlib.sha256(bytes(c for c, f in zip(x, g) if not f)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed):
    r = random.Random(seed)
    words = ["the", "of", "érie", "thonre", "日本", "end.\n", "ñoque", "a"]
    prose = lambda n: " ".join(r.choice(words) + str(r.randrange(50)) for _ in range(n))
    passages = [prose(60) for _ in range(6)]
    rows, made = [], []
    for d in range(70):
        kind = r.randrange(8)
        if kind == 0 and made:
            t = r.choice(made)
        elif kind == 1 and made:
            t = list(r.choice(made))
            for _ in range(r.randint(1, 4)):
                k = r.randrange(len(t) + 1)
                t[k : k + r.randint(0, 3)] = r.choice(["x", "yy", ""])
            t = "".join(t)
        elif kind == 2:
            t = r.choice(["ab ", "x", "Thhaen "]) * r.randint(20, 300)
        elif kind < 6:
            p = r.choice(passages)
            a, b = sorted((r.randrange(len(p)), r.randrange(len(p))))
            t = prose(r.randint(0, 60)) + r.choice([p, p[a:], p[:b], p[a:b] + p[b:] + p[:a]]) + prose(r.randint(0, 60))
        else:
            t = prose(r.randint(0, 120))
        made.append(t)
        rows.append((d, t))
    return [*rows, (500, None), (501, ""), (502, "q" * 199), (503, "q" * 200), (504, "z" * 201)]


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed):
    if seed == 2:
        monkeypatch.setattr(sub, "SLAB", 300)
    rows = corpus(seed)
    got = [tuple(r) for r in sub.digest(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)


@pytest.mark.parametrize("seed", range(3, 23))
def test_contexts_against_brute_force(seed):
    """The steps without Spark, on more corpora and shorter windows."""
    length, piece = 24, 8
    r = random.Random(seed)
    passages = ["".join(r.choice("abcd") for _ in range(60)) for _ in range(4)]
    rows = []
    for d in range(60):
        p = r.choice(passages)
        a, b = sorted((r.randrange(61), r.randrange(61)))
        rows.append((d, "".join(r.choice("abcd") for _ in range(r.randrange(40))) + p[a:b] + "".join(r.choice("abcd") for _ in range(r.randrange(40)))))
    import numpy as np

    by, spans = {}, [[] for _ in rows]
    for k, (_, t) in enumerate(rows):
        for anchor, context, lo, hi, at in zip(*(x.tolist() for x in sub.contexts(np.frombuffer(t.encode(), "u1"), length, piece))):
            by.setdefault(anchor, {}).setdefault(context, []).append((k, lo, hi, at))
    for found in by.values():
        group, places = [], []
        for own in found.values():
            k, lo, hi, at = own[0]
            if len(own) > 1:
                for k2, lo2, hi2, _ in own:
                    spans[k2].append((lo2, hi2))
            places.append((k, lo))
            group.append((len(places) - 1, rows[k][1].encode()[lo:hi], at - lo, len(own)))
        if len(group) > 1:
            for i, a, b in sub.compared(iter([group]), length, piece):
                spans[places[i][0]].append((places[i][1] + a, places[i][1] + b))
    want = {d: (n, s) for d, _, n, s, _ in brute(rows, length)}
    for k, (d, _) in enumerate(rows):
        gone = sub.joined_spans(spans[k])
        assert (sum(b - a for a, b in gone), len(gone)) == want[d]


def test_odd_rows(spark, docs_with_odd_rows):
    rows = [(r.doc_id, r.text) for r in docs_with_odd_rows.collect()]
    got = [tuple(r) for r in sub.digest(docs_with_odd_rows).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()]
    assert sorted(got, key=str) == brute(rows)
    assert sub.digest(docs_with_odd_rows.limit(0)).collect() == []
    cut = sub.without_repeats(docs_with_odd_rows)
    assert cut.columns == docs_with_odd_rows.columns and cut.count() == len(rows)
