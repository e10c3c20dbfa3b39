"""Channels with replay as keyed state: late subscribers first get what was published, then what follows.

events(channel, offset, event, data) in the order of offset. A channel opens with its first event and
ends with the event named terminal; what is published after that opens it anew, or is dropped if
channels must be opened by the event named opening, which also resets one. A ring of the newest events
and the subscribers are list states of the channel, kept by RocksDB and removed when it ends, so the state grows with
open channels, not with events, and a restart goes on from the checkpoint. An event named join subscribes
the one that its data names.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from lodestone.functions import fixed as K
from lodestone.runtime import ship_package

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
JOIN = "join"
_EVENT = "offset bigint, event string, data string"


class Channel(StatefulProcessor):
    """What a channel's events and subscriptions deliver; a delivery without an event is the end of the stream."""

    def __init__(self, most: int, terminal: str, opening: str | None) -> None:
        self.most, self.terminal, self.opening = most, terminal, opening

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", _EVENT)
        self.subscribers = handle.getListState("subscribers", "name string")
        self.opened = handle.getValueState("opened", "yes boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        ring, names = list(self.ring.get()), [r[0] for r in self.subscribers.get()]
        is_open = self.opened.exists()
        # A batch holds a bounded number of a channel's events; the ring is cut once a batch.
        for r in sorted(rows, key=lambda r: r["offset"]):
            if r["event"] == JOIN:
                if is_open:
                    names.append(r["data"])
                    yield from (self._delivery(key, r["data"], e) for e in ring[-self.most :])
                else:
                    yield self._delivery(key, r["data"], (r["offset"], None, None))
                continue
            if self.opening and r["event"] == self.opening:
                is_open, ring, names = True, [], []
                continue
            if not is_open and self.opening:
                continue
            is_open = True
            if r["event"] == self.terminal:
                yield from (self._delivery(key, n, (r["offset"], None, None)) for n in names)
                is_open, ring, names = False, [], []
                continue
            event = (r["offset"], r["event"], r["data"])
            ring = [*ring, event][-self.most :] if len(ring) >= 2 * self.most else [*ring, event]
            yield from (self._delivery(key, n, event) for n in names)
        self._keep(is_open, ring[-self.most :], names)

    def _keep(self, is_open: bool, ring: list, names: list[str]) -> None:
        for state, held in ((self.ring, [tuple(e) for e in ring]), (self.subscribers, [(n,) for n in names])):
            state.put(held) if is_open and held else state.clear()
        self.opened.update((True,)) if is_open else self.opened.clear()

    @staticmethod
    def _delivery(key: tuple, subscriber: str, event: tuple) -> Row:
        return Row(channel=key[0], subscriber=subscriber, offset=event[0], event=event[1], data=event[2])

    def close(self) -> None:
        pass


def deliveries(events: DataFrame, *, most: int = K.REPLAY, terminal: str = "complete", opening: str | None = None) -> DataFrame:
    """(channel, subscriber, offset, event, data): what each subscriber gets, as a stream in append mode.

    Needs the settings STATE_STORE when it is started.
    """
    ship_package(events.sparkSession)
    kind = events.schema["channel"].dataType.simpleString()
    rows = events.select("channel", F.col("offset").cast("long").alias("offset"), "event", "data")
    return rows.groupBy("channel").transformWithState(
        Channel(most, terminal, opening), f"channel {kind}, subscriber string, {_EVENT}", outputMode="Append", timeMode="None"
    )


def replay_buffer(spark: SparkSession, checkpoint: str) -> DataFrame:
    """(channel, offset, event, data): the newest events of every open channel, as the query's checkpoint holds them."""
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "ring").load()
    return state.select(F.col("key.channel").alias("channel"), F.col("list_element.*"))
