"""Epochs, manifests and incremental runs."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from weftgraph.__main__ import main
from weftgraph.plans.scanned import entry_and_roots, scanned_graph
from weftgraph.sinks import documents, encode, manifest


def epochs(df):
    return {r.slot: int(r.epoch) for r in df.collect()}


def test_fold_is_the_sequential_one(spark):
    r = random.Random(4)
    values = {s: [r.randrange(1 << 64) for _ in range(n)] for s, n in (("a", 1), ("b", 700), ("hot", 5000))}
    rows = spark.createDataFrame([(s, k, str(v)) for s, vs in values.items() for k, v in enumerate(vs)], "slot string, k int, v string").withColumn("epoch", F.col("v").cast("decimal(20,0)"))
    expected = {s: encode.combined(vs) for s, vs in values.items()}
    for n in (1, 3, 16):
        assert epochs(manifest.combined_epochs(rows.repartition(n), ["k"])) == expected
    assert epochs(manifest.combined_epochs(rows.limit(0), ["k"])) == {}
    # pairs of neighbouring stretches give the same
    fold = lambda vs: (pow(manifest.FACTOR, len(vs), 1 << 64), encode.combined(vs) - encode.START * pow(manifest.FACTOR, len(vs), 1 << 64)) if vs else (1, 0)
    f, s = fold(values["b"])
    assert (encode.START * f + s) % (1 << 64) == expected["b"]


def test_tables_are_written_once(spark, tmp_path):
    path = f"file://{tmp_path}/out"
    defs = spark.createDataFrame([("A", "f", 1), ("A", "g", 2), ("B", "h", 3), ("C/x y", "k", None), (None, "n", 4)], "module string, key string, line int")
    edges = spark.createDataFrame([("f", "g")], "src string, dst string")
    empty = edges.limit(0)

    def run(d, e):
        made = manifest.write_changed({"definitions": d, "edges": e, "none": empty}, path, {"definitions": "module"})
        return {r.slot: r.status for r in made.collect() if r.status != "same"}

    def times():
        return {f"{top}/{n}": os.stat(f"{top}/{n}").st_mtime_ns for top, _, names in os.walk(tmp_path / "out") for n in names}

    def there(name):
        return sorted(spark.read.parquet(f"{path}/{name}").select("key", "line").collect(), key=str)

    assert set(run(defs, edges).values()) == {"added"}
    assert there("definitions") == sorted(defs.select("key", "line").collect(), key=str)
    assert spark.read.parquet(f"{path}/none").count() == 0
    first = times()
    assert run(defs.repartition(3), edges) == {} and times() == first
    # one module changes, one goes, one comes; the files of the others stay
    later = defs.where("module is null or module != 'C/x y'").withColumn("line", F.when(F.col("key") == "h", 9).otherwise(F.col("line"))).unionByName(spark.createDataFrame([("D", "new", 5)], defs.schema))
    assert run(later, edges) == {"definitions/B": "changed", "definitions/C/x y": "removed", "definitions/D": "added"}
    assert there("definitions") == sorted(later.select("key", "line").collect(), key=str)
    assert all(times()[f] == t for f, t in first.items() if "module=A/" in f or "/edges/" in f)
    # a manifest that is lost means that all is written
    import shutil

    shutil.rmtree(tmp_path / "out" / "_manifest")
    assert set(run(later, edges).values()) == {"added"}
    assert there("definitions") == sorted(later.select("key", "line").collect(), key=str)


def test_entry_and_roots():
    assert entry_and_roots(["src", "lib/M.agda", "lib"]) == ("lib/M.agda", ["src", "lib"])
    assert entry_and_roots(["M.lagda.md"]) == ("./M.lagda.md", ["."])
    assert entry_and_roots(["src/"]) == (None, ["src/"])


@pytest.fixture
def sources(tmp_path):
    for name, text in {"A.agda": "module A where\nimport B\n", "B.agda": "module B where\nimport C", "C.agda": "module C where"}.items():
        (tmp_path / "src").mkdir(exist_ok=True)
        (tmp_path / "src" / name).write_text(text)
    return tmp_path


def test_incremental_command(spark, sources, monkeypatch, capsys):
    from weftgraph.plans import scanned

    scans = []
    made = scanned.scanned_headers
    monkeypatch.setattr(scanned, "scanned_headers", lambda files: scans.append(sorted(os.path.basename(r.file) for r in files.select("file").collect())) or made(files))
    out = sources / "out"
    run = lambda: main(["--format=json", "--json-mode=expanded", "--incremental", "-o", str(out), str(sources / "src" / "A.agda")])
    assert run() == 0
    doc = json.loads((out / "deps.json").read_text())
    assert doc["entryModule"] == "A" and doc["moduleEdges"] == [["A", "B"], ["B", "C"]]
    assert scans.pop() == ["A.agda", "B.agda", "C.agda"]
    written = (out / "deps.json").stat().st_mtime_ns
    assert run() == 0 and scans.pop() == [] and (out / "deps.json").stat().st_mtime_ns == written
    assert "as it was" in capsys.readouterr().err
    (sources / "src" / "B.agda").write_text("module B where\nimport D")
    (sources / "src" / "C.agda").unlink()
    assert run() == 0 and scans.pop() == ["B.agda"]
    doc = json.loads((out / "deps.json").read_text())
    assert doc["moduleEdges"] == [["A", "B"], ["B", "D"]] and doc["modules"] == ["A", "B", "D"]
    plain = documents.expanded(scanned_graph(spark, [str(sources / "src")], entry=f"{sources}/src/A.agda"))
    assert plain == doc


def test_options_without_effect_are_refused(sources, capsys):
    for option in ("--with-terms", "--keep-going", "--resolve-deps", "--with-term-hashes"):
        assert main(["--format=json", "--json-mode=expanded", option, str(sources / "src")]) == 1
        assert option in capsys.readouterr().err
