"""Table schemas and the closed enumerations with their stable codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Wire names and codes are part of the output contract.
STATES = {"Defined": "D", "Postulate": "P", "Hole": "H", "Failed": "F"}
STATE_CODES = {"D": 0, "P": 1, "H": 2, "F": 3}
KIND_CODES = {"function": 0, "projection": 1, "datatype": 2, "record": 3, "constructor": 4, "postulate": 5, "primitive": 6, "other": 7}
ACCESS_CODES = {"unknown": 0, "public": 1, "private": 2}
PROV_CODES = {"signature": 0, "body": 1, "module-local": 2, "unknown": 4}
PROV_RANK = {"signature": 4, "module-local": 2, "body": 1, "unknown": 0}
UNSAFE_BITS = {"non-terminating": 1, "trustme": 2}
SCHEMA_VERSION, NODE_KEY_VERSION, FRAGMENT_FORMAT = 2, 4, 12
#: Above these the analysis is left out of an output and said to be.
TRANSITIVE_NODES, SEARCH_NAMES = 3000, 50_000

TABLES = {
    "source_lines": "file string, line_no int, text string",
    "module_imports": "importer string, imported string",
    "module_files": "module string, file string, ord int",
    "definitions": "key string, module string, short string, state string, kind string, file string, line int, access string, type string, unsafe array<string>, unsolved_metas int, ignorable boolean, where_helper boolean, arity int",
    "name_refs": "src_key string, dst_key string, in_signature boolean, in_body boolean",
    "def_edges": "src string, dst string, prov string",
    "ignored_edges": "src string, dst string",
    "method_impl": "method_key string, binder_key string",
    "applications": "src_key string, dst_key string, applied_args int",
    "reexports_raw": "host string, source string, name string, alias string",
    "spans": "file string, lo int, hi int",
    "private_ranges": "file string, lo int, hi int",
    "arg_positions": "key string, pos int, occurrence string, polarity string, hidden boolean, name string, type string",
    "spine_free": "key string, view string, pos int, in_domain int",
    "clause_patterns": "key string, clause int, pos int, pattern string, free_in_body boolean",
    "term_nodes": "def_key string, node_id int, parent_id int, ord int, tag string, name string, info array<string>, binds boolean",
    "failures": "module string, reason string",
    "fragment_manifest": "module string, options_fp string, content_hash string, format int, key_version int",
}


def code(column: Column, codes: dict[str, int], default: int | None = None) -> Column:
    """The code of a wire name; default for names outside the enumeration."""
    out = None
    for name, value in codes.items():
        out = (F.when(column == name, F.lit(value)) if out is None else out.when(column == name, F.lit(value)))
    return out.otherwise(F.lit(default)) if default is not None else out
