"""Command line: python -m weftgraph [options] PATH...; a PATH is a folder of sources, or the entry file in one; also doctor FILE, --version, --emit-schema, --show-defaults.

Without elaborated facts the input is source text: modules and imports of the roots, as a graph.
"""

from __future__ import annotations

import json
import os
import sys
from pathlib import Path

from weftgraph import __version__
from weftgraph.config import Options, apply_config, compatible, doctor, find_config, parse_arguments, show_defaults, without_effect


def main(argv: list[str]) -> int:
    if "--version" in argv:
        print(f"weftgraph {__version__}")
        return 0
    if "--help" in argv or not argv:
        print(__doc__)
        return 0
    if "--show-defaults" in argv:
        print(show_defaults(), end="")
        return 0
    if "--emit-schema" in argv:
        from weftgraph.sinks.documents import json_schema

        print(json.dumps(json_schema(), indent=2))
        return 0
    flag = next((a.partition("=")[2] for a in argv if a.startswith("--config=")), None)
    argv = [a for a in argv if not a.startswith("--config=")]
    if argv[0] == "doctor":
        import yaml

        path = Path(argv[1]) if len(argv) > 1 and not argv[1].startswith("-") else find_config(Path.cwd(), flag, os.environ.get("WEFTGRAPH_CONFIG"))[0]
        report = doctor(yaml.safe_load(path.read_text()) if path else None, path.parent if path else None)
        for f in report.sorted():
            print(f"{f.severity}: {f.key}: {f.message}" + (f" ({f.hint})" if f.hint else ""))
        errors, warnings = report.counts()
        print(f"{errors} errors, {warnings} warnings")
        return report.exit_code("--strict" in argv)
    path, _ = find_config(Path.cwd(), flag, os.environ.get("WEFTGRAPH_CONFIG"))
    seed = Options()
    if path:
        import yaml

        seed = apply_config(yaml.safe_load(path.read_text()), seed)
    options, roots = parse_arguments(argv, seed)
    errors, notices = compatible(options)
    errors += without_effect(options)
    for n in [*notices, *errors]:
        print(f"weftgraph: {n}", file=sys.stderr)
    if errors:
        return 1
    scan(options, roots)
    return 0


def scan(options: Options, paths: list[str]) -> None:
    """Scan the paths and write the document; with incremental, files that haven't changed aren't scanned, and a document that hasn't isn't written."""
    from pyspark.sql import SparkSession

    from weftgraph.plans.scanned import entry_and_roots, scanned_graph
    from weftgraph.sinks import documents

    spark = SparkSession.builder.appName("weftgraph").getOrCreate()
    entry, roots = entry_and_roots(paths)
    cache = None
    if options.incremental:
        cache = os.path.abspath(options.cache_dir or f"{options.out_dir or '.'}/.weftgraph")
    graph = scanned_graph(spark, roots, options.exclude, options.no_externals, entry, f"file://{cache}/scan" if cache else None)
    if options.format == "dot":
        text: str | dict = documents.module_dot(graph)
    else:
        text = documents.expanded(graph) if options.json_mode == "expanded" else documents.packed_document(graph, options.packed_analytical)
    if options.out_dir is None:
        print(text if isinstance(text, str) else json.dumps(text))
        return
    slot = "deps.dot" if options.format == "dot" else "graph.json" if options.lazy_tree() else "deps.json"
    kept = documents.KeptEpochs(cache, options.gzip) if cache else None
    if kept and kept.same(slot, text, f"{options.out_dir}/{slot}"):
        print(f"weftgraph: {slot} is as it was", file=sys.stderr)
        return
    if slot == "graph.json":
        documents.write_lazy(graph, options.out_dir, options.gzip)
    elif slot == "deps.json":
        documents.write_json(text, f"{options.out_dir}/deps.json")
    else:
        documents.replace_file(f"{options.out_dir}/deps.dot", text.encode())
    if kept:
        kept.note(slot, text)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
