"""What only some definitions and modules have, in documents; kept fragments; scans over several roots."""

from dataclasses import replace

import pytest

from tests.graph.test_outputs import graph  # noqa: F401
from weftgraph.plans.pipeline import assemble
from weftgraph.sinks import documents, encode, fragments
from weftgraph.sources import scan

USAGE = "key string, arity int, syntactic_arity int, removable array<int>, erasable array<int>, requires array<struct<pos:int,needs:int>>, binders array<int>, occurs array<int>"


def test_details(spark, graph):  # noqa: F811
    df = spark.createDataFrame
    more = replace(
        graph[0],
        types=df([("A.f", "N -> N"), ("Skip.z", "N")], "key string, type string"),
        silent=df([("B.g", 2)], "key string, silent long"),
        usage=df([("A.f", 2, 2, [0, 1], [], [(0, 1)], [1], None)], USAGE),
        subterms=df([("A.f", 0, "ff" * 16, 2), ("A.f", 1, "00" * 16, 1)], "key string, node long, hash string, depth int"),
        effective=df([("B", "--erasure"), ("Gone", "--erasure")], "module string, flag string"),
        unsolved=df([("B", [3, 3], [])], "module string, meta_lines array<long>, constraint_lines array<long>"),
        reexports=df([("A", "B", "B.g", "h"), ("A", "A", "A.f", None)], "host string, source string, name string, alias string"),
    )
    g = assemble(more, "p")
    doc = documents.expanded(g)
    at = {d["name"]: d for d in doc["definitions"]}
    assert at["A.f"]["type"] == "N -> N" and "type" not in at["B.g"]
    assert at["B.g"]["unsolvedMetas"] == 2 and "unsolvedMetas" not in at["A.f"]
    assert at["A.f"]["argUsage"] == {"arity": 2, "syntacticArity": 2, "removable": [0, 1], "binders": [1], "requires": [[0, 1]]}
    assert doc["definitionSubtermHashes"][0] == [2**64 - 1, 0] and doc["definitionSubtermDepths"][:2] == [[2, 1], []]
    assert doc["moduleEffectiveOptions"] == {"B": ["--erasure"]} and doc["unsolvedModules"] == {"B": {"metas": [3, 3], "constraints": []}}
    assert doc["externals_summary"] == {"modules": ["Ext"], "postulates_by_module": {"Ext": ["q"]}}
    assert doc["reexports"] == [{"from": "A", "to": "B", "names": ["h"], "renames": {"h": "B.g"}}]
    schema = documents.json_schema()
    assert set(doc) <= set(schema["properties"]) and set(at["A.f"]) | set(at["B.g"]) <= set(schema["$defs"]["definition"]["properties"])
    p = documents.packed_document(g)
    assert encode.unpacked(p["defs"]["subtermOffsets"], "int32") == [0, 2, 2, 2, 2] and encode.unpacked(p["defs"]["subtermHashes"], "uint64") == [2**64 - 1, 0]
    assert p["defs"]["types"] == ["N -> N", None, None, None] and encode.unpacked(p["defs"]["unsolvedMetas"], "int32") == [0, 2, 0, 0]
    assert p["moduleTree"][0] == {"name": "A", "parent": -1, "moduleIndex": 0}
    assert {"name": "lib", "parent": -1, "fileIndex": None} in p["fileTree"] and p["reexports"] == doc["reexports"]
    bad = replace(g, definitions=assemble(replace(more, usage=df([("A.f", 1, 2, [5], [], [], [], [])], USAGE)), "p").definitions)
    with pytest.raises(documents.Invalid, match="argument usage"):
        documents.expanded(bad)


def test_fragments(spark, tmp_path):
    df, path = spark.createDataFrame, f"file://{tmp_path}/store"
    sources = df([("a/b", "h1"), ("c", "h2"), ("empty", "h3")], "module string, content_hash string")
    rows = df([("a/b", 1), ("a/b", 2), ("c", 3), ("other", 9)], "module string, n int")
    names = lambda d: sorted(r.module for r in d.collect())
    found, missing = fragments.reuse(spark, path, "n int", "o", sources)
    assert found.collect() == [] and names(missing) == ["a/b", "c", "empty"]
    fragments.keep(rows, sources, "o", path)
    found, missing = fragments.reuse(spark, path, "n int", "o", sources)
    assert sorted(map(tuple, found.collect())) == [("a/b", 1), ("a/b", 2), ("c", 3)] and names(missing) == []
    assert names(fragments.reuse(spark, path, "n int", "other options", sources)[1]) == ["a/b", "c", "empty"]
    changed = df([("a/b", "h1"), ("c", "h9"), ("new", "h4")], "module string, content_hash string")
    found, missing = fragments.reuse(spark, path, "n int", "o", changed)
    assert names(found) == ["a/b", "a/b"] and names(missing) == ["c", "new"]
    fragments.keep(df([("c", 4)], "module string, n int"), changed.where("module = 'c'"), "o", path)
    found, missing = fragments.reuse(spark, path, "n int", "o", changed)
    assert sorted(map(tuple, found.collect())) == [("a/b", 1), ("a/b", 2), ("c", 4)] and names(missing) == ["new"]
    assert fragments.collect_garbage(spark, path, changed.select("module")) == 1  # empty
    assert names(fragments.manifest(spark, path)) == ["a/b", "c"]
    # rows that can't be read are a miss
    for f in (tmp_path / "store/rows").glob("slot=*/*.parquet"):
        if spark.read.parquet(f"file://{f}").first().module == "a/b":
            f.write_bytes(b"broken")
            (f.parent / f".{f.name}.crc").unlink(missing_ok=True)
    found, missing = fragments.reuse(spark, path, "n int", "o", changed)
    assert sorted(map(tuple, found.collect())) == [("c", 4)] and names(missing) == ["a/b", "new"]


def test_roots(spark, tmp_path):
    inner = tmp_path / "r/inner"
    inner.mkdir(parents=True)
    (inner / "A.agda").write_text("module A where")
    (inner / "big.bin").write_bytes(b"\xff" * 10)
    (tmp_path / "link").symlink_to(inner)
    roots = [str(inner), str(tmp_path / "nowhere"), str(tmp_path / "r"), f"file://{tmp_path}/link"]
    got = scan.source_files(spark, roots).collect()
    assert [(r.file, r.ord) for r in got] == [(f"{inner}/A.agda", 0)]
    assert [r.file for r in scan.source_files(spark, roots[::-1]).collect()] == [f"{tmp_path}/link/A.agda"]
    assert scan.source_files(spark, roots[1:2]).collect() == []
