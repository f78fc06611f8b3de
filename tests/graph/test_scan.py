"""Discovery of source files and comments of any nesting."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from weftgraph.functions import names, text
from weftgraph.sources import scan


def found(spark, roots):
    return sorted((r.ord, r.file, r.text) for r in scan.source_files(spark, [str(r) for r in roots]).collect())


def write(path, body="module M where\n"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(body)


def test_loops_and_hidden_folders(spark, tmp_path):
    root = tmp_path / "scan"
    write(root / "A.agda", "module A where\n")
    write(root / "z" / "B.lagda.md", "module B where\n")
    write(root / ".hidden" / "Ignored.agda")
    write(root / "z" / "notes.txt")
    expected = [(0, f"{root}/A.agda", "module A where\n"), (0, f"{root}/z/B.lagda.md", "module B where\n")]
    assert found(spark, [root]) == expected
    for name in ("loop", "a-loop", "z/back"):
        os.symlink(root, root / name)
        assert found(spark, [root]) == expected
    assert found(spark, [tmp_path / "none", root]) == [(1, f, t) for _, f, t in expected]
    # the same folder by another name, and roots in each other
    os.symlink(root, tmp_path / "alias")
    assert found(spark, [root, tmp_path / "alias", root / "z"]) == expected
    # from z a link leads back to the root, which is visited there
    assert found(spark, [root / "z", root]) == [(0, f"{root}/z/B.lagda.md", "module B where\n"), (0, f"{root}/z/back/A.agda", "module A where\n")]
    (root / "z" / "back").unlink()
    assert found(spark, [root / "z", root]) == [(0, f"{root}/z/B.lagda.md", "module B where\n"), (1, f"{root}/A.agda", "module A where\n")]
    assert found(spark, [f"file://{root}/"]) == expected


def test_fewest_steps_spell_a_folder(spark, tmp_path):
    write(tmp_path / "r" / "m" / "deep" / "D.agda")
    os.symlink(tmp_path / "r" / "m" / "deep", tmp_path / "r" / "y")
    os.symlink(tmp_path / "r" / "m" / "deep", tmp_path / "r" / "x")
    assert [f for _, f, _ in found(spark, [tmp_path / "r"])] == [f"{tmp_path}/r/x/D.agda"]


def test_files_that_cannot_be_read(spark, tmp_path):
    write(tmp_path / "Good.agda")
    (tmp_path / "Bytes.agda").write_bytes(b"\xff\xfe module")
    os.symlink(tmp_path / "nowhere", tmp_path / "Lost.agda")
    got = {os.path.basename(f): t for _, f, t in found(spark, [tmp_path])}
    assert got == {"Good.agda": "module M where\n", "Bytes.agda": None, "Lost.agda": None}
    assert [r.module for r in scan.headers(scan.source_lines(scan.source_files(spark, [str(tmp_path)]))).collect()] == ["M"]


@pytest.mark.skipif(os.getuid() == 0, reason="root reads all folders")
def test_folders_that_cannot_be_read(spark, tmp_path):
    write(tmp_path / "Good.agda")
    write(tmp_path / "shut" / "In.agda")
    os.chmod(tmp_path / "shut", 0)
    assert [os.path.basename(f) for _, f, _ in found(spark, [tmp_path])] == ["Good.agda"]


def test_many_entries_of_a_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(scan, "ENTRIES_AT_ONCE", 7)
    monkeypatch.setattr(scan, "BYTES_AT_ONCE", 40)
    for k in range(30):
        write(tmp_path / f"d{k % 3}" / f"F{k}.agda", f"module F{k} where\n")
    got = found(spark, [tmp_path])
    assert len(got) == 30 and all(t == f"module {os.path.basename(f)[:-5]} where\n" for _, f, t in got)


def test_containment(spark):
    cases = {"/t/project/Local.agda": True, "/t/project-old/External.agda": False, "/t/project/../project-old/External.agda": False, "/t/project/nested/../Local.agda": True, "/t/project/./a//b": True, "/../t/project": True, "/t/project/../..": False, "t/project/x": False, "": False}
    df = spark.createDataFrame([(p,) for p in cases], "path string")
    assert {r.path: r.x for r in df.select("path", names.inside(F.col("path"), F.lit("/t/x/../project/")).alias("x")).collect()} == cases
    plain = lambda p: spark.range(1).select(names.normalised(F.lit(p)).alias("x")).first().x
    assert [plain(p) for p in ("a/../../b", "../../a/..", "/..", "./", "a//./b/")] == ["../b", "../..", "/", "", "a/b"]


def stripped(t: str) -> str:
    """Character by character."""
    out, depth, i = [], 0, 0
    while i < len(t):
        if t.startswith("{-", i):
            depth, i = depth + 1, i + 2
        elif depth and t.startswith("-}", i):
            depth, i = depth - 1, i + 2
        else:
            out += [t[i]] if not depth else []
            i += 1
    return "".join(out)


def test_comments_against_characters(spark):
    r = random.Random(1)
    texts = ["", "{-}", "{-}-}x", "--}{-", "\u0001{-\u0002-}\u0001\u00020"] + ["".join(r.choice("{-}-ab\n\u0001") for _ in range(r.randrange(60))) for _ in range(2000)]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    for block in (512, 4):
        for row in df.select("t", text.without_block_comments(F.col("t"), block=block).alias("x")).collect():
            assert row.x == (None if row.t is None else stripped(row.t))


@pytest.mark.parametrize("piece", ["-", "a-", "{--}", "x{- - -}\n", "{-"])
def test_long_texts_take_time_in_proportion(spark, piece):
    t = piece * (400_000 // len(piece))
    began = time.perf_counter()
    assert spark.createDataFrame([(t,)], "t string").select(text.without_block_comments(F.col("t")).alias("x")).first().x == stripped(t)
    assert time.perf_counter() - began < 20
