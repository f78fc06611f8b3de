"""Totals of nested phases of a run: wall clock, processor time, jobs, tasks, and rows of the tables that came out."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


@dataclass
class Phase:
    path: str
    group: str
    wall: float = 0.0
    cpu: float = 0.0
    jobs: int = 0
    tasks: int = 0
    rows: dict[str, Observation] = field(default_factory=dict)


class Phases:
    """Phases by name, nested ones below their parents; a phase entered twice adds up.

    Each phase's jobs are a job group of their own, whose stages Spark reports; an outer phase's totals include those
    of the phases in it. Rows are observed when a table is first computed, so that counting needs no job.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.found, self.open_ = spark, {}, []

    @contextmanager
    def phase(self, name: str) -> Iterator[Phase]:
        context = self.spark.sparkContext
        path = "/".join([*(p.path.rpartition("/")[2] for p in self.open_), name])
        p = self.found.setdefault(path, Phase(path, f"weftgraph-{uuid.uuid4().hex}"))
        self.open_.append(p)
        context.setJobGroup(p.group, path)
        began = time.perf_counter()
        try:
            yield p
        finally:
            p.wall += time.perf_counter() - began
            self.open_.pop()
            if self.open_:
                context.setJobGroup(self.open_[-1].group, self.open_[-1].path)
            else:
                for key in ("spark.jobGroup.id", "spark.job.description"):
                    context.setLocalProperty(key, None)

    def counted(self, name: str, df: DataFrame) -> DataFrame:
        """df, whose rows are counted under the innermost open phase when it is computed."""
        seen = Observation(name)
        self.open_[-1].rows[name] = seen
        return df.observe(seen, F.count(F.lit(1)).alias("rows"))

    def _measure(self) -> None:
        tracker = self.spark.sparkContext.statusTracker()
        stages = self.spark.sparkContext._jsc.sc().statusStore()
        for p in self.found.values():
            jobs = tracker.getJobIdsForGroup(p.group)
            p.jobs, p.tasks, p.cpu, done = len(jobs), 0, 0.0, set()
            for info in filter(None, map(tracker.getJobInfo, jobs)):
                for s in set(info.stageIds) - done:
                    done.add(s)
                    about = tracker.getStageInfo(s)
                    if about is None:  # skipped, or too long ago for Spark to know
                        continue
                    p.tasks += about.numCompletedTasks
                    p.cpu += stages.lastStageAttempt(s).executorCpuTime() / 1e9

    def rows(self) -> list[tuple[str, str, float]]:
        """(phase, what, value): wall and cpu in seconds, jobs, tasks, and rows of each counted table that has been computed."""
        self._measure()
        out = []
        for path in sorted(self.found):
            below = [p for q, p in self.found.items() if q == path or q.startswith(f"{path}/")]
            out.append((path, "wall", round(self.found[path].wall, 3)))
            out += [(path, what, float(round(sum(getattr(p, what) for p in below), 3))) for what in ("cpu", "jobs", "tasks")]
            for name, seen in sorted(self.found[path].rows.items()):
                out.append((path, f"rows of {name}", float(seen.get["rows"])))
        return out

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows(), "phase string, what string, value double")
