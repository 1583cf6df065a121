"""What stages of work cost: time on the driver, and what the executors measured of the jobs that each stage ran."""

from __future__ import annotations

import threading
import time
import tracemalloc
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PROFILE = (
    "stage string, status string, seconds double, driver_peak_mb double, jobs long, tasks long, executor_seconds double, rows_read long, shuffle_rows long, "
    "shuffle_mb double, spill_mb double, execution_peak_mb double, error string"
)


def _measured(spark: SparkSession, group: str) -> tuple:
    """Sums over the stages of a job group's jobs, each attempt once: jobs, tasks, seconds, rows read, rows and MB shuffled, MB spilled, and the largest execution memory of a task."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty(30_000)
    store = sc.statusStore()
    jobs = [j for j in _each(store.jobsList(None)) if j.jobGroup().isDefined() and j.jobGroup().get() == group]
    ids = {i for j in jobs for i in _each(j.stageIds())}
    got = [s for s in (store.lastStageAttempt(i) for i in ids) if s.numCompleteTasks()]
    total = lambda name: sum(getattr(s, name)() for s in got)
    return (
        len(jobs), total("numCompleteTasks"), total("executorRunTime") / 1e3, total("inputRecords"), total("shuffleWriteRecords"),
        total("shuffleWriteBytes") / 2**20, total("diskBytesSpilled") / 2**20, max([0, *(s.peakExecutionMemory() for s in got)]) / 2**20,
    )


def _each(seq):
    it = seq.iterator()
    while it.hasNext():
        yield it.next()


def profiled(spark: SparkSession, stages: list[tuple[str, Callable[[], object]]], limit: float | None = None) -> DataFrame:
    """A row of PROFILE for each callable, run one after the other; stages is a list of a few names and callables.

    A stage that raises has status ``failed`` and its error, one whose jobs are
    cancelled as it took longer than limit seconds ``timeout``; the stages
    behind it run all the same. Stages that Spark skipped, as their shuffle
    files were there, cost nothing and count nothing.
    """
    sc, rows = spark.sparkContext, []
    for name, run in stages:
        group, late = f"profile-{uuid.uuid4().hex}", threading.Event()

        def stop(group: str = group, late: threading.Event = late) -> None:
            late.set()
            sc.cancelJobGroup(group)

        timer = threading.Timer(limit, stop) if limit else None
        sc.setJobGroup(group, name, True)
        tracemalloc.start()
        began, status, error = time.perf_counter(), "done", None
        try:
            if timer:
                timer.start()
            run()
        except Exception as e:  # a stage's failure is its row
            status, error = ("timeout" if late.is_set() else "failed"), f"{type(e).__name__}: {e}"[:500]
        finally:
            if timer:
                timer.cancel()
            seconds, peak = time.perf_counter() - began, tracemalloc.get_traced_memory()[1] / 2**20
            tracemalloc.stop()
            sc.setLocalProperty("spark.jobGroup.id", None)
        rows.append((name, status, seconds, peak, *_measured(spark, group), error))
    return spark.createDataFrame(rows, PROFILE)


def stage_totals(stages: DataFrame) -> DataFrame:
    """One row over profiled stages: sums of times, rows and sizes, the largest memory of each kind, and how many did not end well; zeros without stages."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("seconds", "executor_seconds", "rows_read", "shuffle_rows", "shuffle_mb", "spill_mb")]
    most = [F.coalesce(F.max(c), F.lit(0.0)).alias(c) for c in ("driver_peak_mb", "execution_peak_mb")]
    return stages.agg(F.count("*").alias("stages"), F.count_if(F.col("status") != "done").alias("unfinished"), *sums, *most)
