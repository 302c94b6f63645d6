"""A stream that runs at an interval given by settings, and follows them as they change.

Settings are a stream of their own: rows (enabled, interval_minutes, saved_at), of which the latest counts, also across
batches. An interval of less than a minute is one minute, none is 30. A new interval stops the query and starts it again
from its checkpoint, and so does the first one; equal settings leave it alone; disabled ones stop it. A query that fails
is started again after its interval. Only the settings' latest row, one a micro-batch, reaches the driver.
"""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

UNSET_MINUTES = 30


def interval(minutes: int | None) -> int:
    return max(1, int(minutes or UNSET_MINUTES))


class _Watch(StreamingQueryListener):
    """Tells a schedule of the runs of its query and of its end."""

    def __init__(self, events: queue.Queue[tuple[str, Any]]) -> None:
        self.events = events

    def onQueryStarted(self, event: Any) -> None:
        pass

    def onQueryProgress(self, event: Any) -> None:
        self.events.put(("ran", (str(event.progress.runId), event.progress.timestamp)))

    def onQueryIdle(self, event: Any) -> None:
        pass

    def onQueryTerminated(self, event: Any) -> None:
        if event.exception:
            self.events.put(("failed", str(event.runId)))


class Schedule:
    """Runs `start(every)`, which starts a query at an interval such as "30 minutes", as the settings say; `wait` gives the seconds before a failed one is started again."""

    def __init__(self, spark: SparkSession, start: Callable[[str], StreamingQuery], wait: Callable[[int], float] = lambda minutes: minutes * 60.0) -> None:
        self.spark, self._start, self._wait = spark, start, wait
        self._events: queue.Queue[tuple[str, Any]] = queue.Queue()
        self._saved_at: Any = None
        self._query: StreamingQuery | None = None
        self._minutes: int | None = None
        self._last_run: str | None = None
        self._starts = 0
        self._watch = _Watch(self._events)
        spark.streams.addListener(self._watch)
        self._thread = threading.Thread(target=self._work, daemon=True)
        self._thread.start()

    def status(self) -> dict[str, Any]:
        """Whether the query runs, its interval, how often it was started, and when its last batch began."""
        return {"running": self._query is not None and self._query.isActive, "interval_minutes": self._minutes, "starts": self._starts, "last_run_at": self._last_run}

    def follow(self, settings: DataFrame, checkpoint: str) -> StreamingQuery:
        """Follows a stream of settings, from the first on that its checkpoint doesn't have; ends with the query that it returns."""
        return settings.writeStream.foreachBatch(self._saved).option("checkpointLocation", checkpoint).start()

    def _saved(self, rows: DataFrame, batch: int) -> None:
        latest = rows.where("saved_at is not null").agg(F.max_by(F.struct("enabled", "interval_minutes", "saved_at"), F.struct("saved_at", "enabled", "interval_minutes")).alias("s")).first()["s"]
        if latest is not None:
            self.apply(bool(latest["enabled"]), latest["interval_minutes"], latest["saved_at"])

    def apply(self, enabled: bool, minutes: int | None, saved_at: Any = None) -> None:
        """Takes settings, unless newer ones were taken; returns at once."""
        self._events.put(("saved", (enabled, interval(minutes), saved_at)))

    def close(self) -> None:
        """Stops the query and follows nothing more."""
        self._events.put(("end", None))
        self._thread.join()
        self.spark.streams.removeListener(self._watch)

    def _stop(self) -> None:
        if self._query is not None:
            self._query.stop()
            self._query = None

    def _begin(self) -> None:
        self._query = self._start(f"{self._minutes} minutes")
        self._starts += 1

    def _work(self) -> None:
        while True:
            kind, what = self._events.get()
            own = self._query is not None and str(self._query.runId)
            if kind == "end":
                self._stop()
                return
            if kind == "saved":
                self._take(*what)
            elif kind == "ran" and what[0] == own:
                self._last_run = what[1]
            elif kind == "failed" and what == own:
                again = threading.Timer(self._wait(self._minutes or UNSET_MINUTES), self._events.put, [("again", what)])
                again.daemon = True
                again.start()
            elif kind == "again" and what == own:
                self._begin()

    def _take(self, enabled: bool, minutes: int, saved_at: Any) -> None:
        if saved_at is not None:
            if self._saved_at is not None and saved_at < self._saved_at:
                return
            self._saved_at = saved_at
        if not enabled:
            self._stop()
            self._minutes = None
        elif minutes != self._minutes or self._query is None:
            self._stop()
            self._minutes = minutes
            self._begin()
