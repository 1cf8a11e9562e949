"""What a load tells of its progress: begin and end of each phase, its rows, its seconds, and the tasks done while it runs."""

from __future__ import annotations

import logging
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

log = logging.getLogger("weftgraph")


@dataclass
class Phases:
    """Seconds and rows by phase, in order. ``every``: seconds between two lines on a phase that goes on; Spark runs a phase's tasks side by side, so tasks stand for batches of rows."""

    spark: SparkSession
    every: float = 10.0
    seconds: dict[str, float] = field(default_factory=dict)
    rows: dict[str, int] = field(default_factory=dict)

    @contextmanager
    def phase(self, name: str) -> Iterator[None]:
        began, done = time.monotonic(), threading.Event()
        watch = threading.Thread(target=self._watch, args=(name, done), daemon=True)
        watch.start()
        try:
            yield
        finally:
            done.set()
            watch.join()
            self.seconds[name] = self.seconds.get(name, 0.0) + time.monotonic() - began
            log.info("%s: %.1f s", name, self.seconds[name])

    def count(self, name: str, rows: int) -> None:
        self.rows[name] = rows
        taken = self.seconds.get(name, 0.0)
        log.info("%s: %d rows in %.1f s, %d a second", name, rows, taken, round(rows / taken) if taken else 0)

    def tasks(self) -> tuple[int, int]:
        """(done, all) of the stages that run now."""
        tracker = self.spark.sparkContext.statusTracker()
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
        return sum(s.numCompletedTasks for s in stages), sum(s.numTasks for s in stages)

    def _watch(self, name: str, done: threading.Event) -> None:
        while not done.wait(self.every):
            try:
                log.info("%s: %d of %d tasks", name, *self.tasks())
            except Exception:  # the session is about to end
                return
