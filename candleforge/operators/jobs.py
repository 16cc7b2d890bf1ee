"""Searches that are watched and stopped while others go on, by the tags of their jobs."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import SparkSession
from pyspark.util import InheritableThread


@dataclass(frozen=True)
class Progress:
    """Jobs of a search so far and those that run, and the tasks of the stages that run."""

    jobs: int
    running: int
    tasks: int
    done: int


class Search:
    """``work`` in a thread of its own, whose jobs bear a tag; ``work`` runs Spark actions and returns what ``result`` gives."""

    def __init__(self, spark: SparkSession, work: Callable[[], Any], name: str = "search"):
        self.spark, self.tag = spark, f"{name}-{uuid.uuid4().hex[:8]}"
        self.value: Any = None
        self.error: BaseException | None = None
        self.stopped = False

        def run() -> None:
            spark.sparkContext.addJobTag(self.tag)
            try:
                self.value = work()
            except Exception as error:  # given to the caller by result()
                self.error = error
            finally:
                spark.sparkContext.removeJobTag(self.tag)

        self.thread = InheritableThread(target=run, session=spark)
        self.thread.start()

    def progress(self) -> Progress:
        status = self.spark.sparkContext.statusTracker()
        store = self.spark.sparkContext._jsc.sc().statusTracker()
        ids = list(store.getJobIdsForTag(self.tag))
        infos = [i for i in map(status.getJobInfo, ids) if i is not None]
        running = [i for i in infos if i.status == "RUNNING"]
        stages = [s for i in running for s in map(status.getStageInfo, i.stageIds) if s is not None]
        return Progress(len(ids), len(running), sum(s.numTasks for s in stages), sum(s.numCompletedTasks for s in stages))

    def stop(self) -> None:
        """Cancels the jobs of this search that run; its ``result`` is an error then."""
        self.stopped = True
        self.spark.sparkContext.cancelJobsWithTag(self.tag)

    def running(self) -> bool:
        return self.thread.is_alive()

    def result(self, timeout: float | None = None) -> Any:
        self.thread.join(timeout)
        if self.thread.is_alive():
            raise TimeoutError(f"{self.tag} still runs")
        if self.error is not None:
            raise RuntimeError(f"{self.tag} was stopped" if self.stopped else f"{self.tag} failed") from self.error
        return self.value
