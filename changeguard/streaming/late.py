"""An account of the rows that streams drop as too late, kept in a table for good."""

from __future__ import annotations

import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from changeguard.sources.commits import CommitLog

LATE_ROWS = "query_id string, query_name string, batch_id long, operator int, operator_name string, dropped long"


class LateRowListener(StreamingQueryListener):
    """Commits the dropped rows of each operator and micro-batch as the batch ends, where there are any."""

    def __init__(self, spark: SparkSession, path: str):
        self.log = CommitLog(spark, path, LATE_ROWS)
        self.log.claim()
        self._open: set[str] = set()
        self._changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        with self._changed:
            self._open.add(str(event.runId))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [
            {"query_id": str(p.id), "query_name": p.name, "batch_id": p.batchId, "operator": n, "operator_name": op.operatorName, "dropped": op.numRowsDroppedByWatermark}
            for n, op in enumerate(p.stateOperators) if op.numRowsDroppedByWatermark]
        if rows:
            self.log.commit(rows)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self._changed:
            self._open.discard(str(event.runId))
            self._changed.notify_all()

    def settle(self, seconds: float) -> bool:
        """Wait until the queries that ended have been told of; progress comes before the end."""
        with self._changed:
            return self._changed.wait_for(lambda: not self._open, seconds)


@contextmanager
def late_rows_to(spark: SparkSession, path: str, seconds: float = 60):
    """Streams that run inside write what they drop to ``path``, one folder for one driver at a time. At the end, queries that still run are waited for up to ``seconds``."""
    listener = LateRowListener(spark, path)
    spark.streams.addListener(listener)
    try:
        yield listener
        listener.settle(seconds)
    finally:
        spark.streams.removeListener(listener)


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """Dropped rows per query, batch and operator: each once, also where a batch ran again after a stop.

    Operators count the rows that reach them: an aggregate those that were added up before, one for each group and task.
    """
    rows = CommitLog(spark, path, LATE_ROWS).read()
    return rows.groupBy("query_id", "query_name", "batch_id", "operator", "operator_name").agg(F.max("dropped").alias("dropped"))
