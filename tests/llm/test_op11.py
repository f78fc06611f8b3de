"""The trie against one that is made of Python tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from weftgraph.llm import op11_prefix_trie as op11

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = tuple(own.get(c - c % 5, [])[:h] + turns[h:])
    return out


def expected(rows):
    convs = rebuilt(rows)
    members, ends = defaultdict(list), defaultdict(list)
    for c, t in convs.items():
        ends[t].append(c)
        for d in range(len(t) + 1):
            members[t[:d]].append(c)
    children = defaultdict(int)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += p not in children
            saved[p[:d]] += (len(m) - 1) * len(p[-1][1]) if p else 0
    return sorted(
        (min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), children.get(p, 0), leaves[p], saved[p], hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest())
        for p, m in members.items()
    )


def made(spark, rows):
    out = op11.trie(spark.createDataFrame(rows, SCHEMA)).collect()
    return sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in out), out


def conversations(r: random.Random):
    rows = []
    for c in [*range(60), 101, 102, 207, 10**12 + 3]:
        for turn in range(r.choice([1, 2, 3, 6, 12])):
            rows.append((c, turn, r.choice(["user", "assistant"]), r.choice(["a", "bé", "ccc"])))
    rows += [(7, None, "user", "first"), (7, None, None, "again"), (8, 3, "user", None), (8, 3, "user", None), (9, 1, None, None), (None, 0, "user", "of none"), (61, 0, "", ""), (62, 5, "user", "x" * 70_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block, piece", [(op11.BLOCK, op11.PIECE), (4, 2)])
def test_against_tuples(spark, monkeypatch, block, piece):
    monkeypatch.setattr(op11, "BLOCK", block)
    monkeypatch.setattr(op11, "PIECE", piece)
    rows = conversations(random.Random(block))
    got, out = made(spark, rows)
    assert got == expected(rows)
    # intervals: places are dense, a child lies in its parent's, and a subtree has as many nodes as its interval
    assert sorted(r.first for r in out) == list(range(len(out)))
    root = next(r for r in out if r.depth == 0)
    assert (root.first, root.last) == (0, len(out) - 1)
    by_place = sorted(out, key=lambda r: r.first)
    for k, r in enumerate(by_place):
        inside = by_place[k + 1 : r.last + 1]
        assert all(x.depth > r.depth and x.last <= r.last for x in inside)
        assert r.last + 1 == len(out) or by_place[r.last + 1].depth <= r.depth
        assert r.n_leaves == sum(x.n_children == 0 for x in [r, *inside])


def test_many_copies_and_one_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(op11, "BLOCK", 64)
    monkeypatch.setattr(op11, "PIECE", 16)
    rows = [(5 * c, t, "user", f"t{t}") for c in range(300) for t in range(3)]  # a third end in one node
    rows += [(2000, t, "user", "long") for t in range(1500)] + [(2001, t, "user", f"own {t}") for t in range(40)]
    assert made(spark, rows)[0] == expected(rows)


def test_turnless_and_lone_conversations(spark):
    # a conversation whose turns are all taken by its group's absent first one is left without any
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 >= 2)
    rows = [(c, 0, "user", "gone"), (c, 1, "user", "too")]
    assert made(spark, rows)[0] == expected(rows) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]
    assert made(spark, [])[0] == []
    assert made(spark, [(None, None, None, None)])[0] == []


def test_other_columns(spark):
    rows = conversations(random.Random(2))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], f"{SCHEMA}, depth int, g1 string")
    assert sorted(tuple(-1 if r[c] is None else r[c] for c in COLUMNS) for r in op11.trie(df).collect()) == expected(rows)
