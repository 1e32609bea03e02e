"""Runs that can be cancelled, and how far they are."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

from ..operators.report import exit_code


class Cancelled(RuntimeError):
    """A run that was cancelled; ``code`` is what the process exits with."""

    code = exit_code(False, False, "cancelled")


class Run:
    """The jobs that one thread starts within this block carry a tag of their own.

    with Run(spark) as run: ...; ``run.cancel()`` from any thread ends its jobs, and the block raises Cancelled;
    ``run.check()`` does so between jobs. ``run.fraction()`` is the share of tasks that are done, of those known so far in
    the run's jobs; it never falls, and is 1 after the block.
    """

    def __init__(self, spark: SparkSession):
        self.context, self.tag = spark.sparkContext, f"quarry-{uuid.uuid4().hex}"
        self.cancelled, self.done, self._most = False, False, 0.0

    def __enter__(self) -> Run:
        self.context.addJobTag(self.tag)
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.context.removeJobTag(self.tag)
        if self.cancelled and (kind is None or issubclass(kind, Exception)):
            raise Cancelled("the run was cancelled") from error
        self.done = kind is None
        return False

    def cancel(self) -> None:
        self.cancelled = True
        self.context.cancelJobsWithTag(self.tag)

    def check(self) -> None:
        if self.cancelled:
            raise Cancelled("the run was cancelled")

    def fraction(self) -> float:
        if self.done:
            return 1.0
        tracker = self.context._jsc.sc().statusTracker()
        tasks = ended = 0
        for job in tracker.getJobIdsForTag(self.tag):
            info = tracker.getJobInfo(job)
            for stage in info.get().stageIds() if info.isDefined() else []:
                known = tracker.getStageInfo(stage)
                if known.isDefined():
                    tasks += known.get().numTasks()
                    ended += known.get().numCompletedTasks()
        self._most = max(self._most, min(0.99, ended / tasks if tasks else 0.0))
        return self._most
