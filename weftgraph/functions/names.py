"""Names and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What names of source files end in.
SOURCE_SUFFIXES = (".agda", ".lagda", ".lagda.md", ".lagda.rst", ".lagda.tex", ".lagda.org", ".lagda.tree", ".lagda.typ")


def is_source(path: Column) -> Column:
    out = F.lit(False)
    for s in SOURCE_SUFFIXES:
        out = out | path.endswith(s)
    return out


def sanitised(name: Column) -> Column:
    """The longest prefix of letters, digits and . _ ' -"""
    return F.regexp_extract(name, r"^[._'\-\p{L}\p{N}]*", 0)


def lifted(name: Column) -> Column:
    """The dotted name without segments that are just an underscore; mixfix names stay."""
    return F.array_join(F.filter(F.split(name, r"\."), lambda x: x != "_"), ".")


def node_key(raw: Column, line: Column) -> Column:
    """The lifted name, with the line if an anonymous module hides where it comes from."""
    return F.when(raw.contains("._.") & line.isNotNull(), F.concat(lifted(raw), F.lit("@"), line.cast("string"))).otherwise(lifted(raw))


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, r"\."), -1)


def module_of(name: Column) -> Column:
    parts = F.split(name, r"\.")
    return F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), ".")


def prefixes(parts: Column, sep: str) -> Column:
    """Proper prefixes of an array of segments, joined: one per length below its own; none for one segment."""
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), sep))).otherwise(F.array().cast("array<string>"))


def under(path: Column, root: Column) -> Column:
    """Whether path lies in root by whole components: project-old is not in project."""
    p, r = F.split(path, "/"), F.split(root, "/")
    return F.slice(p, 1, F.size(r)) == r


def normalised(path: Column) -> Column:
    """The path without empty segments and single dots, and with each pair of dots taken back; above the top of an absolute path is its top, and a relative one keeps the pairs that lead out of it."""
    rooted = path.startswith("/")

    def step(acc: Column, s: Column) -> Column:
        back = (F.size(acc) > 0) & (F.element_at(acc, -1) != "..")
        up = F.when(back, F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(rooted, acc).otherwise(F.array_append(acc, s))
        return F.when(s.isin("", "."), acc).when(s == "..", up).otherwise(F.array_append(acc, s))

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    return F.concat(F.when(rooted, "/").otherwise(""), F.array_join(parts, "/"))


def inside(path: Column, root: Column) -> Column:
    """Whether path lies in root, both normalised: project/../project-old is not in project, project/x/../y is."""
    return under(normalised(path), normalised(root))


def in_module(module: Column, prefix: Column) -> Column:
    """Whether module is prefix or below it: Data has Data.List, not Database."""
    return (module == prefix) | module.startswith(F.concat(prefix, F.lit(".")))


def bigrams(name: Column) -> Column:
    """Distinct pairs of neighbouring characters; none for names shorter than two."""
    return F.when(F.length(name) >= 2, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(name) - 1), lambda i: F.substring(name, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def detail_file(module: Column) -> Column:
    """A module's file name if it is safe as one, else a digest of it."""
    return F.when(module.rlike(r"^[A-Za-z0-9._\-]+$") & ~module.startswith("."), F.concat(module, F.lit(".json"))).otherwise(F.concat(F.md5(module), F.lit(".json")))


def hex_colour(value: Column) -> Column:
    """(r, g, b) of #rrggbb, else null."""
    good = value.rlike("^#[0-9A-Fa-f]{6}$")
    part = lambda k: F.conv(F.substring(value, k, 2), 16, 10).cast("int")
    return F.when(good, F.struct(part(2).alias("r"), part(4).alias("g"), part(6).alias("b")))


def levenshtein_budget(name: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(4), F.floor(F.length(name) / 3).cast("int")))
