"""Query progress to metric records, without touching the query."""
from __future__ import annotations

import sys
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from coldwatch.operators import metrics

PROGRESS_DDL = "source_mode string, progress string, emit_ts bigint"


class ProgressListener(StreamingQueryListener):
    """Hands (source_mode, progress JSON, emit time) of every progress event to ``publish``.

    A failing publisher is reported once and never stops the query.
    """

    def __init__(self, source_mode: str, publish: Callable[[tuple[str, str, int]], None]):
        self._mode, self._publish, self._warned = source_mode, publish, False

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._guarded(lambda: self._publish((self._mode, event.progress.json, int(time.time() * 1000))))

    def _guarded(self, work: Callable[[], None]) -> None:
        try:
            work()
        except Exception as error:  # noqa: BLE001 - metrics must not take the query down
            if not self._warned:
                self._warned = True
                print(f"metrics not published: {type(error).__name__}: {error}", file=sys.stderr)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        flush = getattr(self._publish, "flush", None)
        if flush is not None:
            self._guarded(flush)


class FolderPublisher:
    """Publisher that keeps records and appends them to a folder as JSON, many at a time: one small job per
    ``records`` records or ``seconds``, whichever comes first, and one at ``flush``. Listeners flush when a query ends."""

    def __init__(self, spark: SparkSession, folder: str, records: int = 100, seconds: float = 30.0):
        self._spark, self._folder, self._records, self._seconds = spark, folder, records, seconds
        self._held: list[tuple[str, str, int]] = []
        self._since, self._lock = time.monotonic(), threading.Lock()

    def __call__(self, record: tuple[str, str, int]) -> None:
        with self._lock:
            self._held.append(record)
            due = len(self._held) >= self._records or time.monotonic() - self._since >= self._seconds
        if due:
            self.flush()

    def flush(self) -> None:
        with self._lock:
            held, self._held, self._since = self._held, [], time.monotonic()
        if held:
            self._spark.createDataFrame(held, PROGRESS_DDL).coalesce(1).write.mode("append").json(self._folder)


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """Metric records of everything a folder publisher wrote."""
    return metrics.flatten_progress(spark.read.schema(PROGRESS_DDL).json(folder))
