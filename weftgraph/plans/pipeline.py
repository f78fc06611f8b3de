"""From fact tables to an assembled graph, in the order that its results depend on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.names import under
from weftgraph.operators import edges as E
from weftgraph.operators import filters, fixpoint, indexes, layout, rollups
from weftgraph.plans.phases import Phases
from weftgraph.schema import TRANSITIVE_NODES


@dataclass
class Facts:
    """Input tables. definitions: key, module, short, state, kind, file, line, ignorable, where_helper, arity, unsafe."""

    definitions: DataFrame
    edges: DataFrame  # src, dst, prov, before contraction
    imports: DataFrame  # src, dst
    method_impl: DataFrame  # method_key, binder_key
    applications: DataFrame  # src, dst, applied
    module_files: DataFrame  # module, file
    private_ranges: DataFrame  # file, lo, hi
    entry: DataFrame  # module, one row at most
    failed: DataFrame  # module, reason
    excludes: DataFrame  # prefix
    flags: DataFrame  # module, flag
    reexports: DataFrame | None = None  # host, source, name, alias
    source_files: DataFrame | None = None  # file, with a module or not
    types: DataFrame | None = None  # key, type
    silent: DataFrame | None = None  # key, silent: unsolved metas that no text shows
    usage: DataFrame | None = None  # key and what argusage.violations takes
    subterms: DataFrame | None = None  # key, node, hash, depth
    effective: DataFrame | None = None  # module, flag in force
    unsolved: DataFrame | None = None  # module, meta_lines, constraint_lines


@dataclass
class Graph:
    definitions: DataFrame
    edges: DataFrame
    modules: DataFrame
    module_edges: DataFrame
    transitive_edges: DataFrame
    depths: DataFrame
    layout: DataFrame
    positions: DataFrame
    states: DataFrame
    module_files: DataFrame
    external: DataFrame
    externals_summary: DataFrame
    failed: DataFrame
    entry: DataFrame
    flags: DataFrame
    reexports: DataFrame
    source_files: DataFrame
    effective: DataFrame
    unsolved: DataFrame


def with_details(nodes: DataFrame, facts: Facts) -> DataFrame:
    """Nodes with what is known of some of them only; a table that isn't there makes no column."""
    known = []
    if facts.types is not None:
        known.append(facts.types.select("key", "type"))
    if facts.silent is not None:
        known.append(facts.silent.select("key", F.col("silent").alias("unsolved_metas")))
    if facts.usage is not None:
        known.append(facts.usage.select("key", F.struct(*[c for c in facts.usage.columns if c != "key"]).alias("usage")))
    if facts.subterms is not None:
        known.append(facts.subterms.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "hash", "depth"))).alias("subterms")))
    for k in known:
        nodes = nodes.join(k, "key", "left")
    return nodes


def assemble(facts: Facts, root: str, no_externals: bool = False, phases: Phases | None = None) -> Graph:
    """Excluded targets go first, then contraction, provider edges, access and partial application; externals are
    classified and summed up before they are dropped; one filter then serves every module-level table.

    What is computed here, and not when the graph is written, is told by phase if phases are given."""
    spark = facts.definitions.sparkSession
    phases = phases or Phases(spark)
    with phases.phase("assemble"):
        with phases.phase("definitions"):
            numbered, e, external, summary = _definitions(facts, root, no_externals, phases)
        with phases.phase("modules"):
            return _graph(facts, root, no_externals, numbered, e, external, summary, phases)


def _definitions(facts: Facts, root: str, no_externals: bool, phases: Phases) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(definitions with their ids, edges, external modules, what is said of these)."""
    defs = filters.excluded(facts.definitions, facts.excludes)
    raw = filters.references_to_kept(facts.edges, facts.definitions, facts.excludes)
    ignored = facts.definitions.where("ignorable").select("key")
    kept = defs.where("not ignorable")
    e = fixpoint.settled(E.with_providers(E.contracted(raw, ignored), facts.method_impl))
    points = kept.where("file is not null and line is not null").select("file", F.col("line").cast("long").alias("at"), "key")
    private = rollups.in_spans(points, facts.private_ranges, closed=True).select("key", F.lit("private").alias("a"))
    partial = E.partially_applied(facts.applications, kept)
    kept = kept.join(private.distinct(), "key", "left").withColumn("access", F.when(F.col("a").isNotNull(), "private").when(F.col("file").isNotNull(), "public").otherwise("unknown")).drop("a").join(partial, "key", "left")
    signals = facts.module_files.select("module", under(F.col("file"), F.lit(root)).alias("in_root")).unionByName(kept.where("file is not null").select("module", under(F.col("file"), F.lit(root)).alias("in_root"))).unionByName(facts.imports.select(F.explode(F.array("src", "dst")).alias("module"), F.lit(False).alias("in_root")))
    external = fixpoint.settled(filters.external_modules(signals))
    summary = rollups.externals_summary(kept, external)
    if no_externals:
        kept, e = filters.without_externals(kept, e, external)
    known = kept.select("key")
    e = e.join(known.select(F.col("key").alias("src")), "src", "left_semi").join(known.select(F.col("key").alias("dst")), "dst", "left_semi")
    numbered = fixpoint.settled(phases.counted("definitions", with_details(indexes.indexed(kept, ["key"]), facts)))
    return numbered, fixpoint.settled(phases.counted("edges", e.select("src", "dst", "prov"))), external, summary


def _graph(facts: Facts, root: str, no_externals: bool, numbered: DataFrame, e: DataFrame, external: DataFrame, summary: DataFrame, phases: Phases) -> Graph:
    spark = numbered.sparkSession
    wanted = lambda df: filters.keep(df, facts.excludes, external, no_externals)
    ends = wanted(E.module_nodes(numbered, facts.imports, facts.entry, facts.failed, external, facts.module_files))
    modules = fixpoint.settled(phases.counted("modules", indexes.indexed(ends, ["module"])))
    names = modules.select("module")
    inside = lambda df: df.join(names.select(F.col("module").alias("src")), "src", "left_semi").join(names.select(F.col("module").alias("dst")), "dst", "left_semi")
    m_edges = fixpoint.settled(phases.counted("module_edges", inside(E.module_edges(e, numbered, facts.imports))))
    nodes = names.select(F.col("module").alias("node"))
    hosts = lambda c: names.select(F.col("module").alias(c))
    shared = facts.reexports if facts.reexports is not None else spark.createDataFrame([], "host string, source string, name string, alias string")
    files = facts.module_files.select("file")
    files = files.unionByName(facts.source_files.select("file")) if facts.source_files is not None else files
    effective = facts.effective if facts.effective is not None else spark.createDataFrame([], "module string, flag string")
    unsolved = facts.unsolved if facts.unsolved is not None else spark.createDataFrame([], "module string, meta_lines array<long>, constraint_lines array<long>")
    entry = facts.entry.join(names, "module", "left_semi")
    failed = facts.failed.join(names, "module", "left_semi")
    with phases.phase("implied edges"):
        implied = fixpoint.transitive_edges(m_edges)
    with phases.phase("depths"):
        depths = fixpoint.bfs_depth(m_edges, nodes, entry.select(F.col("module").alias("node")))
    with phases.phase("ranks"):
        pods = layout.pod_layout(fixpoint.longest_ranks(m_edges, nodes))
    return Graph(
        definitions=numbered,
        edges=e,
        modules=modules,
        module_edges=m_edges,
        transitive_edges=implied,
        depths=depths,
        layout=pods,
        positions=layout.grid_layout(numbered.select("key", "module", F.col("idx").alias("ord"))),
        states=rollups.state_counts(numbered, names, failed),
        module_files=facts.module_files.join(names, "module", "left_semi"),
        external=external.join(names, "module", "left_semi"),
        externals_summary=summary,
        failed=failed,
        entry=entry,
        flags=rollups.flag_rollup(facts.flags.join(names, "module", "left_semi")),
        reexports=E.reexports(shared).join(hosts("host"), "host", "left_semi").join(hosts("source"), "source", "left_semi"),
        source_files=filters.files_of_project(files, root, no_externals),
        effective=rollups.flag_rollup(effective.join(names, "module", "left_semi")),
        unsolved=unsolved.join(names, "module", "left_semi"),
    )


def transitive_definition_edges(graph: Graph) -> DataFrame:
    """Empty for graphs too large for it, as an output then says nothing about them."""
    return fixpoint.transitive_edges(graph.edges, TRANSITIVE_NODES)
