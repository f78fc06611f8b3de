"""Predicates on definitions and modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.names import in_module, prefixes, short_name, under

# The file options that let a module escape checks.
OPTION_ESCAPES = [
    "--allow-unsolved-metas", "--allow-incomplete-matches", "--no-positivity-check", "--no-termination-check", "--type-in-type",
    "--omega-in-omega", "--sized-types", "--injective-type-constructors", "--irrelevant-projections", "--experimental-irrelevance",
    "--rewriting", "--local-rewriting", "--cumulativity", "--allow-exec", "--no-load-primitives",
]
UNSOLVED = "unsolved#meta."


def excluded(df: DataFrame, prefixes_df: DataFrame, column: str = "module") -> DataFrame:
    """Rows in no excluded module: an anti-join of a module's own dotted prefixes, so it stays an equi-join."""
    own = df.select(column).distinct().withColumn("p", F.explode(F.concat(prefixes(F.split(column, r"\."), "."), F.array(F.col(column)))))
    bad = own.join(prefixes_df.select(F.col("prefix").alias("p")).distinct(), "p").select(column).distinct()
    return df.join(bad, column, "left_anti")


def references_to_kept(edges: DataFrame, definitions: DataFrame, prefixes_df: DataFrame) -> DataFrame:
    """Edges whose target is in no excluded module: raw references, of ignored definitions too, so nothing is led through what is excluded."""
    gone = definitions.select("key", "module").join(excluded(definitions.select("key", "module"), prefixes_df), "key", "left_anti")
    return edges.join(gone.select(F.col("key").alias("dst")), "dst", "left_anti")


def files_of_project(files: DataFrame, root: str, no_externals: bool) -> DataFrame:
    """Source files (file), with a module or not; without externals only those below root. Exclusions don't concern files."""
    out = files.select("file").where("file is not null").distinct()
    return out.where(under(F.col("file"), F.lit(root))) if no_externals else out


def is_ignorable(d: DataFrame) -> Column:
    """The rules by which a definition is left out as a node: over flags, the raw name and the tag of definitions (null flags are false)."""
    name, base = F.col("raw_name"), short_name(F.col("raw_name"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in d.columns else F.lit(False)
    tag = F.col("tag")
    synthetic = name.contains("..") | base.contains("GeneralizeTel") | base.contains("generalizedField-")
    made = flag("is_pattern_lambda") | flag("is_with_function") | flag("is_kan_operation") | flag("is_inline")
    return (
        flag("is_copy")
        | synthetic
        | ((tag == "function") & made)
        | ((tag == "primitive") & ~flag("has_clauses"))
        | ((tag == "axiom") & (name == "Agda.Primitive.Level"))
        | tag.isin("primitive-sort", "signature-only", "generalizable")
    )


def kind_of(tag: Column, proper_projection: Column) -> Column:
    return F.when((tag == "function") & proper_projection, "projection").when(tag == "axiom", "postulate").when(tag.isin("function", "datatype", "record", "constructor", "primitive"), tag).otherwise("other")


def state_of(name: Column, is_axiom: Column, has_marker: Column, open_metas: Column) -> Column:
    return F.when(name.startswith(UNSOLVED), "H").when(is_axiom, "P").when(has_marker | (open_metas > 0), "H").otherwise("D")


def silent_metas(markers: DataFrame, open_metas: DataFrame, interactions: DataFrame) -> DataFrame:
    """(key, silent): a definition's distinct unsolved markers (key, dst) and its open metas (key, meta) that no interaction point (key, meta) stands for."""
    marked = markers.where(F.col("dst").startswith(UNSOLVED)).select("key", F.col("dst").alias("what")).distinct()
    hidden = open_metas.join(interactions.select("key", "meta"), ["key", "meta"], "left_anti").select("key", F.concat(F.lit("?"), F.col("meta").cast("string")).alias("what")).distinct()
    return marked.unionByName(hidden).groupBy("key").agg(F.count("*").alias("silent"))


def effective_options(options: DataFrame, known: list[str]) -> DataFrame:
    """(module, flags) of the known options in force (module, flag), whether a file names them or not."""
    return options.where(F.col("flag").isin(known)).groupBy("module").agg(F.sort_array(F.collect_set("flag")).alias("flags"))


def unsafe_tags(non_terminating: Column, trust_me: Column) -> Column:
    return F.array_compact(F.array(F.when(non_terminating, F.lit("non-terminating")), F.when(trust_me, F.lit("trustme"))))


def unsafe_bits(tags: Column) -> Column:
    return F.when(F.array_contains(tags, "non-terminating"), 1).otherwise(0) + F.when(F.array_contains(tags, "trustme"), 2).otherwise(0)


def option_escapes(tokens: Column, known: list[str] | None = None) -> Column:
    """Distinct known options among a file's tokens, ascending."""
    return F.sort_array(F.array_intersect(tokens, F.array(*[F.lit(x) for x in known or OPTION_ESCAPES])))


def external_modules(signals: DataFrame) -> DataFrame:
    """Modules none of whose signals (module, in_root) says they are in the root."""
    return signals.groupBy("module").agg(F.bool_or("in_root").alias("in_root")).where(~F.col("in_root")).select("module")


def external_scanned(scanned: DataFrame, imports: DataFrame, root: str) -> DataFrame:
    """Scanned modules (module, file) outside root, and import targets that no file has."""
    outside = scanned.where(~under(F.col("file"), F.lit(root))).select("module")
    missing = imports.select(F.col("dst").alias("module")).join(scanned.select("module"), "module", "left_anti")
    return outside.unionByName(missing).distinct()


def without_externals(definitions: DataFrame, edges: DataFrame, external: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Definitions outside external modules, and the edges between what is left and into what is no definition of theirs."""
    gone = definitions.join(external, "module", "left_semi").select("key")
    kept = definitions.join(external, "module", "left_anti")
    left = edges.join(gone.select(F.col("key").alias("src")), "src", "left_anti").join(gone.select(F.col("key").alias("dst")), "dst", "left_anti")
    return kept, left


def keep(modules: DataFrame, prefixes_df: DataFrame, external: DataFrame, no_externals: bool) -> DataFrame:
    """The one filter of all module-level outputs: not excluded, nor external where externals are not wanted."""
    out = excluded(modules, prefixes_df)
    return out.join(external, "module", "left_anti") if no_externals else out


def in_scope(module: Column, scopes: list[str]) -> Column:
    """Whether a module is in one of the scopes; an empty list takes all."""
    out = F.lit(not scopes)
    for s in scopes:
        out = out | in_module(module, F.lit(s))
    return out
