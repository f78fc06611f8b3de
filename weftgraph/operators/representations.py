"""Inventories of datatypes and records, and whether what is known of their members is complete."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_members(declarations: DataFrame, members: DataFrame, retained: DataFrame) -> DataFrame:
    """(owner, key): members (owner, key, role) that are not retained (key, parameters), or constructors with other parameters than their owner's."""
    own = declarations.select(F.col("key").alias("owner"), F.col("parameters").alias("wanted"))
    known = retained.select("key", "parameters", F.lit(True).alias("known"))
    at = members.select("owner", "key", "role").join(own, "owner").join(known, "key", "left")
    other = (F.col("role") == "constructor") & ~F.col("parameters").eqNullSafe(F.col("wanted"))
    return at.where(F.col("known").isNull() | other).select("owner", "key").distinct()


def inventories(declarations: DataFrame, members: DataFrame, retained: DataFrame) -> DataFrame:
    """declarations (key, kind, parameters, indices, recursion, closed) with constructors, fields, complete and limitations; closed means abstract or opaque."""
    of = lambda role: F.array_sort(F.collect_set(F.when(F.col("role") == role, F.col("key"))))
    lists = members.groupBy(F.col("owner").alias("key")).agg(of("constructor").alias("constructors"), of("field").alias("fields"))
    gone = missing_members(declarations, members, retained).select(F.col("owner").alias("key"), F.lit(True).alias("gone")).distinct()
    none = F.array().cast("array<string>")
    out = declarations.join(lists, "key", "left").join(gone, "key", "left")
    limits = F.array_compact(F.array(F.when(F.col("closed"), F.lit("abstract-or-opaque")), F.when(F.col("gone"), F.lit("missing-member-signatures"))))
    return out.select(*declarations.columns, F.coalesce("constructors", none).alias("constructors"), F.coalesce("fields", none).alias("fields"), F.col("gone").isNull().alias("complete"), limits.alias("limitations"))


def constructor_views(inventory: DataFrame, results: DataFrame) -> DataFrame:
    """(name, owner, status, limitations) for each constructor of the inventory.

    results (name, result_owner, supported) say what a constructor's type ends in. Only the one constructor of an
    open, plain, nonrecursive declaration has a view; it is complete if its type ends in the owner and the owner's
    inventory is complete.
    """
    each = inventory.select("*", F.explode("constructors").alias("name")).join(results, "name", "left")
    bars = F.array_compact(
        F.array(
            F.when(F.col("closed"), F.lit("abstract-or-opaque")),
            F.when(F.col("indices") != 0, F.lit("indexed")),
            F.when(F.size("constructors") != 1, F.lit("multiple-or-zero-constructors")),
            F.when(F.col("recursion") != "nonrecursive", F.concat(F.lit("recursion-"), F.col("recursion"))),
        )
    )
    status = F.when(F.size(bars) > 0, "unavailable").when(~F.coalesce("supported", F.lit(False)), "partial").when(~F.col("result_owner").eqNullSafe(F.col("key")), "partial").when(~F.col("complete"), "partial").otherwise("complete")
    why = F.when(F.size(bars) > 0, bars).when(~F.coalesce("supported", F.lit(False)), F.array(F.lit("unsupported-telescope"))).when(~F.col("result_owner").eqNullSafe(F.col("key")), F.array(F.lit("blocked-constructor-result")))
    why = why.when(~F.col("complete"), F.array(F.lit("owner-inventory-incomplete"))).otherwise(F.array().cast("array<string>"))
    return each.select("name", F.col("key").alias("owner"), status.alias("status"), why.alias("limitations"))


def plain_splits(splits: DataFrame, constructors: DataFrame, datatypes: DataFrame) -> DataFrame:
    """(split) of case splits (split, constructor) all of whose constructors (constructor, parent) are of one datatype (key, indices) without indices."""
    plain = datatypes.where("indices = 0").select(F.col("key").alias("parent"), F.lit(True).alias("plain"))
    at = splits.join(constructors.select("constructor", "parent"), "constructor", "left").join(plain, "parent", "left")
    one = at.groupBy("split").agg(F.count_distinct("parent").alias("parents"), F.bool_and(F.coalesce("plain", F.lit(False))).alias("plain"))
    return one.where("parents = 1 and plain").select("split")
