"""Requests in flight as keyed state: a repeated request waits for the first one's result.

events(key, at, kind, id, value): kind request asks for a key's operation, result and error end it. The first
request of a key that is not in flight owns it and is to be run; those that come while it runs wait. A result or an
error goes to the owner and to all who wait, and the key is free again. An owner that does not end within
the time limit, by the clock of the events, ends with an error, so that nobody waits for ever.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.runtime import ship_package

REQUEST, RESULT, ERROR = "request", "result", "error"
START, TIMED_OUT = "start", "timed out"


class InFlight(StatefulProcessor):
    """State of a key: who waits, the owner first."""

    def __init__(self, limit_ms: int) -> None:
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "id string")

    def _clear(self) -> None:
        self.waiting.clear()
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        waiting, due = [r[0] for r in self.waiting.get()], None
        for r in sorted(rows, key=lambda r: (r["at"], r["kind"] == REQUEST, r["id"] or "")):
            if r["kind"] == REQUEST:
                if not waiting:
                    yield Row(key=key[0], id=r["id"], kind=START, value=None)
                    due = int(r["at"].timestamp() * 1000) + self.limit_ms
                waiting.append(r["id"])
            elif waiting:
                yield from (Row(key=key[0], id=i, kind=r["kind"], value=r["value"]) for i in waiting)
                waiting, due = [], None
                self._clear()
        if waiting:
            self.waiting.put([(i,) for i in waiting])
            if due is not None:
                self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        yield from (Row(key=key[0], id=r[0], kind=ERROR, value=TIMED_OUT) for r in list(self.waiting.get()))
        self._clear()

    def close(self) -> None:
        pass


def in_flight(events: DataFrame, *, limit: str | timedelta = "15 minutes", late: str = "0 seconds") -> DataFrame:
    """(key, id, kind, value): start for each owner, then result or error for it and for all who waited; in append mode.

    Needs the settings channels.STATE_STORE when it is started.
    """
    ship_package(events.sparkSession)
    if isinstance(limit, str):
        n, unit = limit.split()
        limit = timedelta(**{unit if unit.endswith("s") else f"{unit}s": float(n)})
    kind = events.schema["key"].dataType.simpleString()
    rows = events.withWatermark("at", late).select("key", "at", "kind", F.col("id").cast("string").alias("id"), F.col("value").cast("string").alias("value"))
    return rows.groupBy("key").transformWithState(
        InFlight(int(limit.total_seconds() * 1000)), f"key {kind}, id string, kind string, value string", outputMode="Append", timeMode="EventTime"
    )
