"""Progress of running queries: metrics that the plan observes, gathered by a listener, as an event table.

observed() adds a count to a stream without another pass. The listener adds it up by query and run, one row
for each batch; a batch that is run again after a failure counts once. What is not yet written is held,
one small row a batch, until flush appends it to a table.
"""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.window import Window as W

from lodestone.operators.events import with_percent

METRIC = "progress"
_KIND = "query string, run string, batch bigint, at string, n bigint"


def observed(stream: DataFrame, done: Column | None = None) -> DataFrame:
    """The stream with a count of its rows, or of those for which done holds."""
    return stream.observe(METRIC, (F.count(F.lit(1)) if done is None else F.count_if(done)).alias("n"))


class ProgressLog(StreamingQueryListener):
    """Add it with spark.streams.addListener; it sees every query whose stream is observed()."""

    def __init__(self) -> None:
        self._rows: list[tuple] = []
        self._lock = threading.Lock()
        self.ended: dict[str, str | None] = {}  # of each run, the error it ended with

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if (got := p.observedMetrics.get(METRIC)) is not None:
            with self._lock:
                self._rows.append((p.name, str(p.runId), p.batchId, p.timestamp, got["n"]))

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.ended[str(event.runId)] = event.exception

    def flush(self, spark: SparkSession, path: str) -> int:
        """Append what came since the last call; how many rows. Not from a listener's own thread."""
        with self._lock:
            rows, self._rows = self._rows, []
        if rows:
            spark.createDataFrame(rows, _KIND).coalesce(1).write.mode("append").parquet(path)
        return len(rows)


def percentages(events: DataFrame, totals: DataFrame) -> DataFrame:
    """events as flushed and totals(query, total) -> (query, batch, completed, total, percent) after each batch of a query, over its restarts."""
    once = events.groupBy("query", "batch").agg(F.max_by("n", "at").alias("n"))
    sofar = F.sum("n").over(W.partitionBy("query").orderBy("batch"))
    return with_percent(once.withColumn("completed", sofar).drop("n").join(totals, "query"))
