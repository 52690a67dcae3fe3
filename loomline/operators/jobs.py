"""Work that can be watched and stopped: what a thread runs under a tag."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import TypeVar

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

Result = TypeVar("Result")


class Stopped(Exception):
    """The work was stopped from outside."""


@dataclass(frozen=True)
class Progress:
    """Jobs of a tag that are under way, and the tasks of their stages: done, running, failed and in all. The count grows as later stages begin."""

    jobs: int = 0
    done: int = 0
    running: int = 0
    failed: int = 0
    total: int = 0


@contextmanager
def tagged(spark: SparkSession, tag: str) -> Iterator[None]:
    """All jobs that this thread starts inside have the tag."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def run(spark: SparkSession, tag: str, work: Callable[[], Result]) -> Result:
    """work() under the tag; Stopped if stop() ended it. A write that is stopped commits nothing."""
    try:
        with tagged(spark, tag):
            return work()
    except Exception as e:
        if _was_cancelled(e):
            raise Stopped(tag) from e
        raise


def _was_cancelled(e: BaseException | None) -> bool:
    while e is not None:
        if (isinstance(e, PySparkException) and e.getCondition() == "SPARK_JOB_CANCELLED") or "SPARK_JOB_CANCELLED" in str(e):
            return True
        e = e.__cause__
    return False


def stop(spark: SparkSession, tag: str) -> None:
    """Ends the tag's jobs that are under way, on all executors; those of others go on."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession, tag: str) -> Progress:
    """How far the tag's work is now."""
    tracker = spark.sparkContext.statusTracker()
    jobs = [info for k in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag) if (info := tracker.getJobInfo(k)) and info.status == "RUNNING"]
    stages = [info for job in jobs for k in job.stageIds if (info := tracker.getStageInfo(k))]
    return Progress(len(jobs), *(sum(getattr(s, c) for s in stages) for c in ("numCompletedTasks", "numActiveTasks", "numFailedTasks", "numTasks")))
