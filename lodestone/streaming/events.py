"""Structured Streaming forms of the event operators.

The sources are any streaming tables with the columns named; state is kept per key and ends
with the watermark where one is given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators.events import STAGE, trace_costs


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A folder of Parquet event files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stage_states_stream(events: DataFrame, keys: list[str]) -> DataFrame:
    """Update-mode stream of the latest state of each stage."""
    s = events.where("event = 'stage'").withColumn("s", F.from_json("data", STAGE)).where("s.name IS NOT NULL AND s.name <> ''")
    return s.groupBy(*keys, F.col("s.name").alias("name")).agg(F.max_by("s", "offset").alias("state"), F.min("offset").alias("first"))


def trace_costs_stream(traces: DataFrame) -> DataFrame:
    """Update-mode stream of each trace's cost: the batch operator itself."""
    return trace_costs(traces)


def windowed_counts(events: DataFrame, *, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None, key: str = "event_type") -> DataFrame:
    """Append-mode event-time windows, tumbling or sliding; later events than the watermark are dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "10 minutes", key: str = "user_id") -> DataFrame:
    """Append-mode session windows per key."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count(F.lit(1)).alias("n"))


def dedup_in_flight(requests: DataFrame, *, key: str = "request_id", late: str = "10 minutes") -> DataFrame:
    """The first request of each key within the watermark; in_flight gives repeats its result."""
    return requests.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def fan_out(stream: DataFrame, sinks: dict, checkpoint: str):
    """Each batch goes to every sink (name -> callable(batch, number)); a sink's failure stops no other.

    Returns the query and the list that failures are added to.
    """
    failures: list[tuple[str, int, str]] = []

    def put(batch: DataFrame, number: int) -> None:
        batch.persist()
        for name, sink in sinks.items():
            try:
                sink(batch, number)
            except Exception as e:  # one handler must not end the others
                failures.append((name, number, str(e)[:200]))
        batch.unpersist()

    q = stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    return q, failures
