"""Progress of long stages: counts that come with the rows, the share of tasks that are done, and cancelling.

A watched frame counts its rows, and those that failed, while they are written, so there is no second pass.  A stage runs under a
job group of its own, by which another thread can ask how far it is or stop it.  Streams report the same counts for every batch.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

T = TypeVar("T")


def _counts(failed: Column | None) -> list[Column]:
    wrong = F.coalesce(failed, F.lit(False)) if failed is not None else F.lit(False)
    return [F.count(F.lit(1)).alias("rows"), F.count_if(wrong).alias("failed")]


class Stage:
    """One run of a stage: ``run`` writes a frame, the others may be called from any thread."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self.group = f"{name}-{uuid.uuid4().hex}"
        self.observation: Observation | None = None
        self.ended = False

    def run(self, df: DataFrame, write: Callable[[DataFrame], T], failed: Column | None = None) -> T:
        """``write`` of the frame, whose rows are counted, and of these the ones for which ``failed`` holds.  The frame must be written once."""
        context = self.spark.sparkContext
        self.observation = Observation(f"{self.name}-{uuid.uuid4().hex}")
        names = ("spark.jobGroup.id", "spark.job.description", "spark.job.interruptOnCancel")
        before = {n: context.getLocalProperty(n) for n in names}
        context.setJobGroup(self.group, self.name, True)
        try:
            return write(df.observe(self.observation, *_counts(failed)))
        finally:
            self.ended = True
            for name, value in before.items():
                context.setLocalProperty(name, value)

    def counts(self) -> dict[str, int]:
        """Rows done and failed of an ended run."""
        if self.observation is None or not self.ended:
            raise RuntimeError(f"{self.name} has not ended")
        return dict(self.observation.get)

    def percent(self) -> int:
        """Share of the known tasks that are done, 0 to 100; tasks of stages that are not planned yet are unknown."""
        if self.ended:
            return 100
        tracker, done, known = self.spark.sparkContext.statusTracker(), 0, 0
        for job in tracker.getJobIdsForGroup(self.group):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                if facts := tracker.getStageInfo(stage):
                    done, known = done + facts.numCompletedTasks, known + facts.numTasks
        return min(99, 100 * done // known) if known else 0

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.group)


def watched(stream: DataFrame, name: str, failed: Column | None = None) -> DataFrame:
    """A stream whose batches report their counts to listeners under ``name``."""
    return stream.observe(name, *_counts(failed))


class Totals(StreamingQueryListener):
    """Sums of the counts of watched streams by name, over all batches since it was added to the session."""

    def __init__(self):
        self.sums: dict[str, dict[str, int]] = {}
        self.errors: list[str] = []
        self.lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        with self.lock:
            for name, row in event.progress.observedMetrics.items():
                mine = self.sums.setdefault(name, {"rows": 0, "failed": 0})
                for c in mine:
                    mine[c] += row[c]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if event.exception:
            with self.lock:
                self.errors.append(event.exception)
