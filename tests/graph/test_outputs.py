import gzip
import itertools
import json
import os

import pytest

from weftgraph import config
from weftgraph.plans.pipeline import Facts, assemble
from weftgraph.plans.scanned import DEFINITIONS, facts_of_sources, scanned_graph
from weftgraph.sinks import documents, encode


@pytest.fixture(scope="module")
def graph(spark):
    d = spark.createDataFrame(
        [
            ("A.f", "A", "f", "D", "function", "p/A.agda", 3, False, False, 2, None),
            ("A.h", "A", "h", "D", "function", "p/A.agda", 9, True, False, 0, None),
            ("B.g", "B", "g", "H", "function", "p/B.agda", 2, False, True, 1, ["trustme"]),
            ("B.m", "B", "m", "D", "projection", "p/B.agda", 5, False, False, 1, None),
            ("Ext.q", "Ext", "q", "P", "postulate", "lib/Ext.agda", 1, False, False, 0, None),
            ("Skip.z", "Skip", "z", "D", "function", "p/Skip.agda", 1, False, False, 0, None),
        ],
        DEFINITIONS,
    )
    df = spark.createDataFrame
    facts = Facts(
        definitions=d,
        edges=df([("A.f", "A.h", "body"), ("A.h", "B.g", "signature"), ("A.f", "B.m", "signature"), ("B.g", "Ext.q", "body"), ("B.g", "Skip.z", "body")], "src string, dst string, prov string"),
        imports=df([("A", "B"), ("B", "Ext"), ("A", "Ext"), ("A", "A")], "src string, dst string"),
        method_impl=df([("B.m", "B.g")], "method_key string, binder_key string"),
        applications=df([("A.f", "B.g", 0)], "src string, dst string, applied long"),
        module_files=df([("A", "p/A.agda"), ("B", "p/B.agda"), ("Ext", "lib/Ext.agda")], "module string, file string"),
        private_ranges=df([("p/B.agda", 4, 6)], "file string, lo long, hi long"),
        entry=df([("A",)], "module string"),
        failed=df([("Bad", "no parse")], "module string, reason string"),
        excludes=df([("Skip",)], "prefix string"),
        flags=df([("A", "--rewriting")], "module string, flag string"),
    )
    return facts, assemble(facts, "p")


def test_assembled(graph):
    g = graph[1]
    assert {(r.src, r.dst, r.prov) for r in g.edges.collect()} == {("A.f", "B.g", "body"), ("A.f", "B.m", "signature"), ("B.g", "Ext.q", "body")}
    assert {r.key: (r.access, r.partially_applied) for r in g.definitions.collect()} == {"A.f": ("public", False), "B.g": ("public", True), "B.m": ("private", False), "Ext.q": ("public", False)}
    assert [r.module for r in g.modules.orderBy("idx").collect()] == ["A", "B", "Bad", "Ext"]
    assert {r.node: r.depth for r in g.depths.collect()} == {"A": 0, "B": 1, "Bad": -1, "Ext": 1}
    assert [(r.src, r.dst) for r in g.transitive_edges.collect()] == [("A", "Ext")]
    assert [r.module for r in g.external.collect()] == ["Ext"]
    assert [(r.module, r.postulates) for r in g.externals_summary.collect()] == [("Ext", ["q"])]


def test_without_externals(graph):
    g = assemble(graph[0], "p", no_externals=True)
    assert [r.module for r in g.modules.orderBy("idx").collect()] == ["A", "B", "Bad"]
    assert {(r.src, r.dst) for r in g.edges.collect()} == {("A.f", "B.g"), ("A.f", "B.m")}
    assert [r.module for r in g.externals_summary.collect()] == ["Ext"]


def test_packed_is_expanded(graph):
    e, p = documents.expanded(graph[1]), documents.packed_document(graph[1])
    json.dumps([e, p])
    back = documents.unpack(p)
    assert back["edges"] == dict(zip(map(tuple, e["definitionEdges"]), e["definitionEdgesProvenance"]))
    for d in e["definitions"]:
        own = back["definitions"][d["name"]]
        assert own == {"module": d["module"], "state": d["state"], "kind": d["kind"], "line": d.get("line"), "access": d.get("access", "unknown")}
    schema = documents.json_schema()
    assert set(schema["required"]) <= set(e) <= set(schema["properties"])
    for d in e["definitions"]:
        assert set(schema["$defs"]["definition"]["required"]) <= set(d)


def test_violations(spark, graph):
    from dataclasses import replace

    g = graph[1]
    bad = [
        (replace(g, edges=g.edges.unionByName(spark.createDataFrame([("A.f", "Nope", "body")], g.edges.schema))), "edge to or from no definition"),
        (replace(g, modules=g.modules.where("module != 'B'")), "no module"),
        (replace(g, definitions=g.definitions.unionByName(g.definitions.where("key = 'A.f'"))), "definition listed twice"),
        (replace(g, entry=spark.createDataFrame([("Gone",)], "module string")), "entry is no module"),
    ]
    for x, says in bad:
        with pytest.raises(documents.Invalid, match=says):
            documents.expanded(x)


def test_files(graph, tmp_path):
    documents.write_lazy(graph[1], str(tmp_path), zipped=True)
    names = sorted(os.listdir(tmp_path / "modules"))
    assert names == ["A.json", "A.json.gz", "B.json", "B.json.gz", "Bad.json", "Bad.json.gz", "Ext.json", "Ext.json.gz"]
    assert json.loads((tmp_path / "modules/Bad.json").read_text())["reason"] == "failed"
    out = json.loads((tmp_path / "modules/A.json").read_text())["outEdges"]
    assert [(x["source"], x["target"], x["target_module"]) for x in out] == [(0, 1, "B"), (0, 2, "B")]
    assert gzip.decompress((tmp_path / "graph.json.gz").read_bytes()) == (tmp_path / "graph.json").read_bytes()
    documents.write_tables(graph[1], f"file://{tmp_path}/tables")
    assert (tmp_path / "tables/definitions/module=A").is_dir()
    target = tmp_path / "x"
    target.write_text("old")
    target.chmod(0o640)
    documents.replace_file(target, b"new")
    assert target.read_text() == "new" and target.stat().st_mode & 0o777 == 0o640
    with pytest.raises(TypeError):
        documents.replace_file(target, 5)
    assert target.read_text() == "new" and not [p for p in os.listdir(tmp_path) if p.startswith(".x")]


def test_dot(graph):
    m, d = documents.module_dot(graph[1]), documents.definition_dot(graph[1], "dark")
    assert '"A" [label="A", color="#e94560", penwidth=2];' in m and '"Ext" [label="Ext", color="#8090a8"' in m and '"A" -> "B";' in m
    assert "subgraph cluster_0" in d and documents.PALETTES["dark"][2] in d and '"Bad"' in d
    assert documents.quoted('a"b\\c') == '"a\\"b\\\\c"'


def test_encodings():
    assert encode.packed([1, 256], "int32") == "AQAAAAABAAA=" and encode.unpacked("AQAAAAABAAA=", "int32") == [1, 256]
    assert encode.csr(3, [(2, 0), (0, 2), (0, 1), (0, 1)]) == ([0, 2, 2, 3], [1, 2, 0])
    assert encode.combined([1, 2]) != encode.combined([2, 1])


def test_scanned_sources(spark, tmp_path):
    for name, text in {"A.agda": "module A where\nimport z.B\nopen import Lost", "z/B.lagda.md": "module z.B where\n", ".hid/C.agda": "module C where", "z/note.txt": "module N where", "E.agda": "nothing"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    g = scanned_graph(spark, [f"file://{tmp_path}"], entry=f"{tmp_path}/A.agda")
    assert [r.module for r in g.modules.orderBy("idx").collect()] == ["A", "Lost", "z.B"]
    assert {(r.src, r.dst) for r in g.module_edges.collect()} == {("A", "Lost"), ("A", "z.B")}
    assert [r.module for r in g.external.collect()] == ["Lost"]
    assert [r.module for r in g.entry.collect()] == ["A"]
    assert facts_of_sources(spark, spark.createDataFrame([], "file string, text string")).imports.count() == 0


def test_options():
    o, rest = config.parse_arguments(["--format=json", "--exclude", "A", "x", "--exclude=B", "-o", "out", "--lazy", "--", "--gzip"])
    assert (o.format, o.exclude, o.out_dir, o.lazy, o.gzip, rest) == ("json", ("A", "B"), "out", True, False, ["x", "--gzip"])
    for words in itertools.permutations(["--theme=dark", "--color-hole=#000000", "--color-failed=#111111"]):
        p = config.parse_arguments(list(words))[0].palette()
        assert p == {"D": documents.PALETTES["dark"][0], "P": documents.PALETTES["dark"][1], "H": "#000000", "F": "#111111"}
    for bad in (["--format=xml"], ["--color-hole=red"], ["--min-term-depth=x"], ["--out-dir"], ["--lazy=1"]):
        with pytest.raises(ValueError):
            config.parse_arguments(bad)
    seed = config.apply_config({"format": "json", "exclude": ["Q"]}, config.Options())
    assert config.parse_arguments(["--exclude=R"], seed)[0].exclude == ("Q", "R")
    assert config.compatible(config.Options(with_terms=True))[0] and config.compatible(config.Options(lazy=True, format="json"))[0]
    assert config.compatible(config.Options(lazy=True))[1] and config.compatible(config.Options()) == ([], [])


def test_doctor():
    keys = lambda c: sorted((f.severity, f.key) for f in config.doctor(c).findings)
    assert keys(None) == [] and keys({"format": "json"}) == []
    assert keys({"fromat": "json"}) == [("error", "fromat")] and config.doctor({"fromat": 1}).findings[0].hint == "did you mean format?"
    assert keys({"lazy": True}) == [("note", "lazy"), ("warning", "lazy")]
    assert ("error", "with-terms") in keys({"with-terms": True})
    assert keys({"color-hole": "red"}) == [("error", "color-hole")]
    assert keys({"skip-agda": True, "keep-going": True}) == [("warning", "keep-going")]
    assert config.doctor({"lazy": True}).exit_code() == 0 and config.doctor({"lazy": True}).exit_code(strict=True) == 1
    assert keys([1]) == [("error", "")]


def test_discovery_and_libraries(tmp_path):
    deep = tmp_path / "a/b"
    deep.mkdir(parents=True)
    assert config.find_config(deep) == (None, "none")
    (tmp_path / "x.agda-lib").touch()
    (tmp_path / config.CONFIG_NAME).touch()
    assert config.find_config(deep) == (tmp_path / config.CONFIG_NAME, "library")
    (deep / config.CONFIG_NAME).touch()
    assert config.find_config(deep)[1] == "folder"
    with pytest.raises(FileNotFoundError):
        config.find_config(deep, flag="nope")
    libs = {"p": ("/p", ["q", "r"]), "q": ("/q", ["r"]), "r": ("/r", [])}
    assert config.library_closure(libs, "p") == ["/p", "/q", "/r"] and config.library_closure({"p": ("/p", ["x"])}, "p") is None
    assert config.ownership("/p/src/A", "/p", {"d": "/p/deps/d"}) == "project"
    assert config.ownership("/p/deps/d/A", "/p", {"d": "/p/deps/d"}) == "d"
    assert config.ownership("/p-old/A", "/p", {}) is None
    assert "# format: dot" in config.show_defaults()
