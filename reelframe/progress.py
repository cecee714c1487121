"""Progress of Spark's work while it runs."""

from __future__ import annotations

import threading
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def watched(spark: SparkSession, tell: Callable[[int, int], None], name: str = "reelframe", every_s: float = 1.0):
    """Calls tell(tasks done, tasks known) about every second while the jobs of the block run, and once at its end.

    Only what this thread starts within the block counts; the number of known tasks grows as jobs begin.
    """
    context, stop = spark.sparkContext, threading.Event()
    context.setJobGroup(name, name)
    seen: dict[int, tuple[int, int]] = {}

    def look():
        tracker = context.statusTracker()
        for job in tracker.getJobIdsForGroup(name):
            info = tracker.getJobInfo(job)
            for stage in info.stageIds if info else ():
                found = tracker.getStageInfo(stage)
                if found and found.numTasks:
                    seen[stage] = found.numCompletedTasks, found.numTasks
        tell(sum(d for d, _ in seen.values()), sum(n for _, n in seen.values()))

    def poll():
        while not stop.wait(every_s):
            look()

    thread = threading.Thread(target=poll, daemon=True)
    thread.start()
    try:
        yield
    finally:
        stop.set()
        thread.join()
        look()
        context.setLocalProperty("spark.jobGroup.id", None)
