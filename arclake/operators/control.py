"""Ceilings, progress and cancellation of an operation."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import InheritableThread
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arclake.operators.pack import PackError


@dataclass(frozen=True)
class Limits:
    """Ceilings of an operation, which may be met but not passed; None has no end.

    ``diagnostics`` is what ``validate.retain`` keeps of an operation, a count of the others included.
    """

    entries: int | None = 1_000_000
    metadata_bytes: int | None = 1 << 30
    decoded_bytes: int | None = 1 << 40
    scratch_bytes: int | None = 1 << 38
    diagnostics: int = 4096


MEASURED = ("entries", "metadata_bytes", "decoded_bytes", "scratch_bytes")


def index_bytes(family: Column, display: Column) -> Column:
    """Bytes that an entry takes in its archive's index: record, name, hash."""
    name = F.octet_length(display).cast("long")
    return F.when(family.startswith("TES3"), name + 21).when(family.endswith("BSA") | family.startswith("FO3"), name + 17).otherwise(name + 38)


def measured(entries: DataFrame, by: list[str]) -> DataFrame:
    """Per archive what limits are compared with."""
    return entries.groupBy(*by).agg(
        F.count(F.lit(1)).alias("entries"), F.sum(index_bytes(F.col("family"), F.col("display"))).alias("metadata_bytes"),
        F.sum("decoded_size").alias("decoded_bytes"), F.sum("stored_size").alias("scratch_bytes"),
    )


def passed(entries: DataFrame, limits: Limits, by: list[str]) -> DataFrame:
    """Archives that pass a ceiling, and the first that they pass."""
    over = [F.when(F.col(name) > most, name) for name in MEASURED if (most := getattr(limits, name)) is not None]
    first = F.coalesce(*over) if over else F.lit(None).cast("string")
    return measured(entries, by).select(*by, first.alias("limit")).filter("limit is not null")


def require(entries: DataFrame, limits: Limits, by: list[str]) -> None:
    if not passed(entries, limits, by).isEmpty():
        raise PackError("operation.resource-limit")


@dataclass(frozen=True)
class Progress:
    """A snapshot: jobs that run, and their tasks."""

    jobs: int
    tasks: int
    done: int
    failed: int


class Cancelled(RuntimeError):
    """``operation.cancelled``: the operation was stopped before it had ended."""


class Operation:
    """An action that runs beside its caller, who may look at its progress or cancel it.

    It runs as a job group of its own, so that cancelling stops its tasks on all executors; a publication that has not
    begun to move files leaves nothing behind.
    """

    def __init__(self, spark: SparkSession, action: Callable[[], object]) -> None:
        self.spark, self.group = spark, f"arclake-{uuid.uuid4().hex}"
        self.result: object = None
        self.error: BaseException | None = None
        self.stopped = threading.Event()

        def run() -> None:
            spark.sparkContext.setJobGroup(self.group, "arclake", interruptOnCancel=True)
            try:
                self.result = action()
            except BaseException as fault:  # handed to the caller by wait()
                self.error = fault

        self.thread = InheritableThread(target=run)
        self.thread.start()

    def progress(self) -> Progress:
        tracker = self.spark.sparkContext.statusTracker()
        jobs = [j for j in (tracker.getJobInfo(i) for i in tracker.getJobIdsForGroup(self.group)) if j is not None]
        stages = [s for s in (tracker.getStageInfo(i) for j in jobs for i in j.stageIds) if s is not None]
        return Progress(sum(j.status == "RUNNING" for j in jobs), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages), sum(s.numFailedTasks for s in stages))

    def cancel(self) -> None:
        self.stopped.set()
        self.spark.sparkContext.cancelJobGroup(self.group)

    def wait(self) -> object:
        self.thread.join()
        if self.error is not None:
            if self.stopped.is_set():
                raise Cancelled("operation.cancelled") from self.error
            raise self.error
        return self.result
