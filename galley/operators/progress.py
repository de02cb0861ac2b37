"""Progress of a run: its stages as they begin, and the share of each that is done, read from Spark's own count of tasks.

    with Progress(spark, told, {"parsing": 0.1, "writing": 0.6}) as progress:
        progress.stage("parsing")
        ...

told(stage, fraction) is called when a stage begins and, between beginnings, whenever more tasks are done. No action is run for it:
a thread of the driver asks the status tracker about the jobs of the stage's job group. Fractions never fall and end at 1.0, unless
the run fails. What told raises stops neither the run nor later calls.
"""

from __future__ import annotations

import logging
import threading
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

Told = Callable[[str, float], None]
log = logging.getLogger(__name__)


def ahead(begins: float, ends: float, done: int, tasks: int) -> float:
    """A fraction between a stage's beginning and its end."""
    return begins + (ends - begins) * (min(done, tasks) / tasks if tasks else 0.0)


class Progress:
    """Stages with the fraction at which each begins, in order; a stage ends where the next begins, the last at 1.0."""

    def __init__(self, spark: SparkSession, told: Told | None, stages: dict[str, float], every: float = 0.5):
        self.context, self.told, self.stages, self.every = spark.sparkContext, told, stages, every
        self.run, self.name, self.last = uuid.uuid4().hex, None, -1.0
        self.lock, self.over, self.thread = threading.Lock(), threading.Event(), None

    def __enter__(self) -> Progress:
        if self.told:
            self.thread = threading.Thread(target=self._watch, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.over.set()
        if self.thread:
            self.thread.join()
        self._leave()
        if kind is None:
            self._tell("done", 1.0)

    def _leave(self) -> None:
        for name in ("spark.jobGroup.id", "spark.job.description"):
            self.context.setLocalProperty(name, None)

    def stage(self, name: str) -> None:
        """The jobs of this thread belong to the stage from here on."""
        self.context.setJobGroup(f"{self.run}-{name}", name)
        self.name = name
        self._tell(name, self.stages[name])

    def _tell(self, name: str, fraction: float, begins: bool = True) -> None:
        """Told under the lock, so that calls come in order; a count that comes late is dropped."""
        with self.lock:
            if self.told is None or fraction < self.last or fraction == self.last and not begins:
                return
            self.last = fraction
            try:
                self.told(name, fraction)
            except Exception:  # a listener's fault is not the run's
                log.exception("progress could not be told")

    def _counted(self, name: str) -> tuple[int, int]:
        """(tasks done, tasks known) of a stage's jobs."""
        tracker = self.context.statusTracker()
        jobs = (tracker.getJobInfo(j) for j in tracker.getJobIdsForGroup(f"{self.run}-{name}"))
        stages = [s for j in jobs if j for i in j.stageIds if (s := tracker.getStageInfo(i))]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)

    def _watch(self) -> None:
        ends = dict(zip(self.stages, [*list(self.stages.values())[1:], 1.0], strict=True))
        while not self.over.wait(self.every):
            if (name := self.name) is None:
                continue
            fraction = ahead(self.stages[name], ends[name], *self._counted(name))
            if fraction < ends[name]:
                self._tell(name, fraction, begins=False)
