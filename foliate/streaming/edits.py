"""Edits that are written once they rest, or at once where a flush asks for it: a stateful stream with timers."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What is held of a key, and what is written: times are microseconds since 1970.
STATE = "value string, edits long, at long"
OUT = "key string, value string, edits long, at long, flushed boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Resting(StatefulProcessor):
    """Of each key the last edit is held until the quiet time has passed since, or a flush comes: then it is written, once.

    Rows are (key, value, at, place, flush), of which those of a batch are taken in order of time and place. An edit exactly
    the quiet time after another joins it; a flush writes what is held, and nothing where nothing is.
    """

    def __init__(self, quiet_ms: int, by_event_time: bool):
        self.quiet, self.by_event_time = quiet_ms, by_event_time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803 (names of the interface)
        now = tuple(self.held.get()) if self.held.exists() else None
        for r in sorted(rows, key=lambda r: (r.micros, r.place)):
            if now and r.micros - now[2] > 1000 * self.quiet:
                yield self.row(key, now, False)
                now = None
            if not r.flush:
                now = (r.value, 1 + (now[1] if now else 0), r.micros)
            elif now:
                yield self.row(key, now, True)
                now = None
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if now:
            self.held.update(now)
            since = now[2] // 1000 if self.by_event_time else timerValues.getCurrentProcessingTimeInMs()
            self.handle.registerTimer(since + self.quiet + 1)
        else:
            self.held.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        if self.held.exists():
            now = tuple(self.held.get())
            self.held.clear()
            yield self.row(key, now, False)

    @staticmethod
    def row(key, now: tuple, flushed: bool) -> Row:
        return Row(key=key[0], value=now[0], edits=now[1], at=now[2], flushed=flushed)

    def close(self) -> None:
        pass


def resting(edits: DataFrame, quiet_ms: int = 1000, by_event_time: bool = False, late: str = "10 seconds") -> DataFrame:
    """Over a stream (key string, value string, at timestamp, place long, flush boolean): rows (key, value, edits, at, flushed) of the edits
    that are to be written. Timers go by the clock, or by event time, whose end is told by edits of any key.

    State is in Spark's key-value store, so it grows with the keys that hold an edit; a stream that is stopped goes on from its checkpoint. Rows without
    a key are one key's.
    """
    edits.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = (edits.withWatermark("at", late) if by_event_time else edits).withColumn("micros", F.unix_micros("at"))
    found = rows.groupBy("key").transformWithState(Resting(quiet_ms, by_event_time), OUT, "Append", "EventTime" if by_event_time else "ProcessingTime")
    return found.withColumn("at", F.timestamp_micros("at"))
