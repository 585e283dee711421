"""The run tracker as a stateful operator with event-time timers on the RocksDB state store.

Structured Streaming hands a stateful operator its rows in any order, so events
wait in list state until the watermark passes them; then they are folded into
a run's totals in the order of (ts, event_id).  A run's totals are six values,
whatever its length, and only changed keys are written to the state store.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpuslens import rules

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_TOTALS = "n_events long, last_us long, last_event_id long, last_state string, attempts long, illegal long"
_WAITING = "us long, event_id long, state string"


def legal_pairs() -> set[tuple[str, str]]:
    pairs = {(s, n) for s, _, n in (*rules.RULE_TRANSITIONS, *rules.CODED_TRANSITIONS)}
    return pairs | {("COMPLETED", "COMPLETED")}  # a run may say COMPLETED more than once


def fold(totals: tuple, events: list[tuple], legal: set) -> tuple:
    """Totals behind `events` (microseconds, event_id, state), which are in order."""
    n, last_us, last_id, last, attempts, illegal = totals
    for us, event_id, state in events:
        illegal += last is not None and (last, state) not in legal
        attempts += state == "PATCH"
        n, last_us, last_id, last = n + 1, us, event_id, state
    return n, last_us, last_id, last, attempts, illegal


class RunTracker(StatefulProcessor):
    """One row of totals for every run that a trigger touches; see `stream_run_tracker`."""

    NONE = (0, None, None, None, 0, 0)

    def __init__(self, legal: set, terminal: tuple, linger_ms: int | None, columns: list[str]):
        self.legal, self.terminal, self.linger_ms, self.columns = legal, terminal, linger_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", _TOTALS)
        self.waiting = handle.getListState("waiting", _WAITING)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        yield self._advance(key, [(r.us, r.event_id, r.state) for r in rows], timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def _advance(self, key, fresh: list, watermark_ms: int) -> Row:
        """Fold what the watermark has passed, keep the rest waiting, and show the totals behind both."""
        kept = self.totals.get()  # None where there is none; every question to the state store is a message to the JVM
        totals = self.NONE if kept is None else tuple(kept)
        held = [tuple(r) for r in self.waiting.get()]
        events = sorted([*held, *fresh], key=lambda e: (e[0], e[1] is not None, e[1]))
        cut = sum(e[0] <= watermark_ms * 1000 for e in events)
        if cut:
            totals = fold(totals, events[:cut], self.legal)
            self.totals.update(totals)
        rest = events[cut:]
        if rest:
            self.waiting.put(rest)
        elif held:
            self.waiting.clear()
        if held or kept is not None:  # a run without state has no timer
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        shown = fold(totals, rest, self.legal)
        ended = not rest and shown[3] in self.terminal
        if rest:  # the next event to be passed
            self.handle.registerTimer(max(rest[0][0] // 1000, watermark_ms) + 1)
        elif ended and self.linger_ms is not None:
            until = shown[1] // 1000 + self.linger_ms
            if until <= watermark_ms:
                self.totals.clear()  # evicted: its row has been shown
            else:
                self.handle.registerTimer(until)
        return Row(**dict(zip(self.columns, (key[0], *shown, shown[3] in self.terminal), strict=True)))

    def close(self) -> None:
        pass


def stream_run_tracker(events: DataFrame, delay: str = "10 minutes", linger: str | None = None,
                       terminal: tuple = ("COMPLETED", "ERROR")) -> DataFrame:
    """Totals per run over (run_id, event_id, ts, state) events: one row per run and trigger that touches it.

    Rows: (run_id, n_events, last_ts, last_event_id, final_state, attempts,
    illegal_transitions, terminal).  A row tells all events seen so far in the order
    of (ts, event_id), those still waiting for the watermark (ts - `delay`)
    included; the row with the most events is a run's present state.  Events
    that come after the watermark has passed them are dropped by Spark, as are
    events without a time.  Null run ids are one run.

    With `linger`, a run whose last event is terminal gives its state back once
    the watermark is so far behind that event; an event later than that starts
    the run's totals anew.

    What a run keeps is its totals and the events of the last `delay`; these
    are sorted in the task, so `delay` and the trigger bound its memory.  Start
    it with `start_tracker`, as timers need the RocksDB state store.
    """
    id_type = events.schema["run_id"].dataType.simpleString()
    columns = ["run_id", "n_events", "last_us", "last_event_id", "final_state", "attempts", "illegal_transitions", "terminal"]
    shape = f"run_id {id_type}, n_events long, last_us long, last_event_id long, final_state string, attempts long, illegal_transitions long, terminal boolean"
    linger_ms = None if linger is None else int(pd.Timedelta(linger).value // 1_000_000)
    tracker = RunTracker(legal_pairs(), tuple(terminal), linger_ms, columns)
    told = events.select("run_id", "event_id", "ts", F.unix_micros("ts").alias("us"), "state").where("ts IS NOT NULL").withWatermark("ts", delay)
    rows = told.groupBy("run_id").transformWithState(tracker, shape, "Append", "EventTime")
    return rows.select("run_id", "n_events", F.timestamp_micros("last_us").alias("last_ts"), *columns[3:])


def start_tracker(rows: DataFrame, folder: str, available_now: bool = True):
    """Write the tracker's rows below `folder`, with its checkpoint; a second start on the same folder goes on where the first ended."""
    spark, setting = rows.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting, None)
    spark.conf.set(setting, ROCKSDB)  # read when the query starts
    try:
        writer = (rows.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/rows")
                  .option("checkpointLocation", f"{folder}/checkpoint"))
        return (writer.trigger(availableNow=True) if available_now else writer).start()
    finally:
        if before is None:
            spark.conf.unset(setting)
        else:
            spark.conf.set(setting, before)
