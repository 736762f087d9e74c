"""What every micro-batch of the streams read, kept and skipped, as a table.

Streams count rows with ``observe`` while they pass by; Spark reports the counts after each micro-batch to
listeners. A log holds a row per micro-batch and count until it is saved.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.listener import StreamingQueryListener

BATCHES = "query_id string, batch bigint, input_rows bigint, metric string, value bigint"


class BatchLog(StreamingQueryListener):
    """Listen with ``spark.streams.addListener(log)``, or as ``with BatchLog(spark) as log``."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._rows: list[tuple] = []
        self._ended: set[str] = set()
        self._change = threading.Condition()

    def __enter__(self) -> BatchLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.numInputRows == 0 and not p.observedMetrics:
            return  # idle
        counts = [(name, int(n)) for row in p.observedMetrics.values() for name, n in row.asDict().items() if n is not None]
        with self._change:
            self._rows += [(str(p.id), p.batchId, p.numInputRows, *c) for c in (counts or [("read", p.numInputRows)])]

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._change:
            self._ended.add(str(event.id))
            self._change.notify_all()

    def wait_for(self, query_ids, seconds: float = 60) -> None:
        """Until the ends of these queries were reported: reports come after, and in order."""
        with self._change:
            if not self._change.wait_for(lambda: set(map(str, query_ids)) <= self._ended, seconds):
                raise TimeoutError("no report of the end of a stream")

    def table(self) -> DataFrame:
        with self._change:
            return self.spark.createDataFrame(list(self._rows), BATCHES)

    def save(self, path: str) -> None:
        """Append what is held to the stored table and forget it."""
        with self._change:
            rows, self._rows = self._rows, []
        self.spark.createDataFrame(rows, BATCHES).write.mode("append").parquet(path)
