import numpy as np

from weftgraph.llm import op7_neighbours as near


def brute(rows, every, k):
    ok = {i: np.array(v, np.float64) for i, v in rows if i is not None and v is not None and len(v) and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for q in ok:
        if q % every == 0:
            out[q] = sorted(((float((ok[q] * x).sum()), i) for i, x in ok.items() if i != q), key=lambda t: (-t[0], t[1]))[:k]
    return out


def test_recall_and_order(spark):
    r = np.random.default_rng(1)
    centres = r.standard_normal((12, 32)) * 2
    x = (centres[r.integers(0, 12, 3000)] + r.standard_normal((3000, 32))).astype(np.float32)
    x[100:160] = x[100]  # a group of copies
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for g in near.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    want = brute(rows, 20, 20)
    assert got.keys() == want.keys()
    hits = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, 21))
        assert [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
        assert all(abs(s - float((x[q].astype(float) * x[i].astype(float)).sum())) < 1e-9 for _, i, s in found)
        hits += len({i for _, i, _ in found} & {i for _, i in want[q]})
    assert hits >= 0.97 * 20 * len(want)


def test_odd_rows(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 1.0]), (2, [2.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, []), (None, [1.0, 1.0]), (9, [1.0, 2.0, 3.0]), (20, [1.0, 0.0]), (20, [1.0, 0.0])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, score string")
    got = sorted(tuple(r) for r in near.nearest(df, df.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 2, 2.0), (0, 2, 20, 1.0), (0, 3, 1, 0.5), (20, 1, 2, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 0.5)]
    assert near.nearest(df.limit(0), df.limit(0)).collect() == []
    assert near.nearest(df.where("vec_id = 0"), df.where("vec_id = 0")).collect() == []


def test_any_number_of_lengths(spark):
    r = np.random.default_rng(7)
    rows = [(20 * i + j, r.standard_normal(i + 1).astype(np.float32).tolist()) for i in range(11) for j in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for g in near.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id))
    vectors = {i: np.array(v, np.float64) for i, v in rows}
    for i in range(11):
        q = vectors[20 * i]
        want = sorted((20 * i + j for j in (1, 2)), key=lambda k: -float((q * vectors[k]).sum()))
        assert sorted(got[20 * i]) == [(1, want[0]), (2, want[1])]


def test_codes():
    r = np.random.default_rng(2)
    x = r.standard_normal((2000, 16))
    model = near.fit(x, 4, 64)
    wide, narrow = ((x - model.decode(model.encode(x, b))) ** 2 for b in (8, 1))
    assert wide.sum() <= narrow.sum() < 0.6 * (x**2).sum()
    tables = model.tables(x[:3])
    codes = model.encode(x)
    assert np.allclose(sum(tables[1][m][codes[:, m]] for m in range(4)), model.decode(codes) @ x[1].astype(np.float32), atol=1e-3)


def test_repeated_rows(spark):
    """Rows alike, and one id with many vectors, take no places from others."""
    r = np.random.default_rng(3)
    x = r.standard_normal((60, 8)).round(3)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] * 30
    rows += [(7, (x[0] * 9 + 0.1 * r.standard_normal(8)).tolist()) for _ in range(900)] + [(20, (x[20] * 5 + 0.1 * r.standard_normal(8)).tolist()) for _ in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    own = {}
    for i, v in rows:
        own.setdefault(i, []).append(v)
    got = {}
    for g in near.nearest(df, df.where("vec_id % 20 = 0")).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert got.keys() == {0, 20, 40}
    for q, found in got.items():
        score = {i: (np.array(own[q]) @ np.array(v).T).max() for i, v in own.items() if i != q}
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [(k, i) for k, i, _ in sorted(found)] == list(enumerate(want, 1))
        assert np.allclose([s for _, _, s in sorted(found)], [score[i] for i in want])


def test_blocks_have_bounded_bytes():
    import pyarrow as pa

    x = np.random.default_rng(4).standard_normal((1500, 4096)).astype(np.float32)
    batches = [pa.RecordBatch.from_pydict({"vec_id": pa.array(range(a, a + 500)), "embedding": pa.array(list(x[a : a + 500]))}) for a in range(0, 1500, 500)]
    model = near.Codebooks(np.zeros((1, 1, 4096)))
    blocks = list(near._index_blocks(batches, model, near.BLOCK, True))
    assert max(len(b.column("vectors")[0].as_py()) for b in blocks) <= 8 << 20
    assert sum(len(b.column("ids")[0].as_py()) for b in blocks) == 1500 * 8


def test_many_cells(spark, monkeypatch):
    """Each group of queries meets each shard of the index once; ids with rows in several blocks count once."""
    monkeypatch.setattr(near, "HELD", 2000)
    monkeypatch.setattr(near, "SHARD", 1)
    monkeypatch.setattr(near, "BLOCK", 50)
    monkeypatch.setattr(near, "QUERIES", 2)
    r = np.random.default_rng(6)
    x = r.standard_normal((400, 12)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(i, (v * 2).tolist()) for i, v in enumerate(x[:90])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = df.where("vec_id % 20 = 0 and vec_id >= 100")
    got = {}
    for g in near.nearest(df, queries).collect():
        got.setdefault(g.query_id, []).append((g["rank"], g.vec_id, g.score))
    assert len(got) == 15
    for q, found in got.items():
        score = {}
        for i, v in rows:
            if i != q:
                score[i] = max(score.get(i, -np.inf), float((x[q] * np.array(v)).sum()))
        want = sorted(score, key=lambda i: (-score[i], i))[:20]
        assert [(k, i) for k, i, _ in sorted(found)] == list(enumerate(want, 1))


def test_grid():
    for index_blocks, query_blocks, query_bytes in ((0, 0, 0), (1, 1, 10**5), (5, 3, 10**6), (1300, 1100, 6 * 10**8), (6500, 5000, 3 * 10**9)):
        shards, groups = near.grid(index_blocks, query_blocks, query_bytes, 24)
        assert query_bytes <= groups * near.HELD and index_blocks <= shards * near.SHARD
        # copies grow with groups that fill memory and shards that a task passes through, not with blocks
        assert groups <= max(24, query_bytes // near.HELD + 1) and shards <= max(24, index_blocks // near.SHARD + 1)
