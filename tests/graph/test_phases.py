"""Totals by phase."""

import time

from pyspark.sql import functions as F

from tests.graph.test_outputs import graph  # noqa: F401
from weftgraph.operators.fixpoint import settled
from weftgraph.plans.phases import Phases
from weftgraph.plans.pipeline import assemble


def test_nested_phases(spark):
    phases = Phases(spark)
    with phases.phase("all"):
        with phases.phase("first"):
            settled(phases.counted("numbers", spark.range(5000).withColumn("x", F.col("id") % 7)))
            time.sleep(0.2)
        for _ in range(2):
            with phases.phase("again"):
                spark.range(10).count()
        spark.range(10).count()
    spark.range(10).count()  # outside of all
    got = {(r.phase, r.what): r.value for r in phases.table().collect()}
    assert got["all/first", "rows of numbers"] == 5000
    assert got["all/again", "jobs"] >= 2 and got["all/first", "jobs"] >= 1
    # two counts in the inner phase, one in the outer one
    assert got["all", "jobs"] == got["all/first", "jobs"] + got["all/again", "jobs"] * 1.5
    assert got["all", "tasks"] >= got["all/first", "tasks"] + got["all/again", "tasks"] > 2
    assert got["all", "wall"] >= got["all/first", "wall"] >= 0.2
    assert got["all", "cpu"] >= got["all/first", "cpu"] > 0
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_phases_of_an_assembly(spark, graph):  # noqa: F811
    phases = Phases(spark)
    made = assemble(graph[0], "p", phases=phases)
    got = {(p, what): value for p, what, value in phases.rows()}
    assert got["assemble/definitions", "rows of definitions"] == made.definitions.count() == 4
    assert got["assemble/definitions", "rows of edges"] == made.edges.count()
    assert got["assemble/modules", "rows of modules"] == made.modules.count()
    assert {p for p, _ in got} == {"assemble", "assemble/definitions", "assemble/modules", "assemble/modules/depths", "assemble/modules/implied edges", "assemble/modules/ranks"}
    assert got["assemble", "jobs"] > got["assemble/modules", "jobs"] > 0
