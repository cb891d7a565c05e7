"""Progress of streaming queries as plain rows."""

from __future__ import annotations

import threading

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQueryListener


class ProgressLog(StreamingQueryListener):
    """Remembers the last ``most`` events: (name, stage, batch, rows, error)."""

    def __init__(self, most: int = 1000):
        self.rows: list[tuple] = []
        self._most, self._lock = most, threading.Lock()

    def _add(self, *row: object) -> None:
        with self._lock:
            self.rows = [*self.rows[1 - self._most :], row]

    def onQueryStarted(self, event) -> None:  # noqa: N802, ANN001
        self._add(event.name, "started", None, None, None)

    def onQueryProgress(self, event) -> None:  # noqa: N802, ANN001
        p = event.progress
        self._add(p.name, "progress", p.batchId, p.numInputRows, None)

    def onQueryIdle(self, event) -> None:  # noqa: N802, ANN001
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802, ANN001
        self._add(None, "finished", None, None, event.exception)


def watch(spark: SparkSession, most: int = 1000) -> ProgressLog:
    """Register a log with the session; ``spark.streams.removeListener`` takes it off again."""
    log = ProgressLog(most)
    spark.streams.addListener(log)
    return log
