"""Freshness of running stages, from the progress that their queries report."""

from __future__ import annotations

import datetime as dt
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

STAGE_LOG = "stage string, timestamp timestamp, rows long"


class StageListener(StreamingQueryListener):
    """Keeps, for each named query, when it last received rows; register it with ``spark.streams.addListener``.

    A trigger without input leaves the time as it was, so a silent stage grows old. ``stage_log`` is what
    ``operators.serving.stage_health`` takes.
    """

    def __init__(self) -> None:
        self._last: dict[str, tuple[dt.datetime, int]] = {}
        self._triggers: dict[str, int] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        name = progress.name or str(progress.id)
        with self._lock:
            self._triggers[name] = self._triggers.get(name, 0) + 1
            if progress.numInputRows > 0:
                at = dt.datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00"))
                self._last[name] = (at, self._last.get(name, (at, 0))[1] + progress.numInputRows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def triggers(self, name: str) -> int:
        with self._lock:
            return self._triggers.get(name, 0)

    def stage_log(self, spark: SparkSession) -> DataFrame:
        """One row per stage that received rows: its last time and all rows so far."""
        with self._lock:
            rows = [(name, at, n) for name, (at, n) in self._last.items()]
        return spark.createDataFrame(rows, STAGE_LOG)
