"""Cases as streams in event time: rows of a key are folded in the order of their time, whatever batch they come in, as far as the watermark waits for them.

A key's rows wait in state in stretches of time. When the watermark has passed a stretch, a timer hands its rows over, sorted, to the fold, so that a task holds one stretch of one
key and not all rows of a key in a batch. Rows behind the watermark are dropped by Spark and counted (``late_rows``). Timers also end what ends without a row: deliveries expire by themselves,
and a key without rows for ``idle`` loses its state. State is kept by RocksDB below the query's checkpoint.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from itertools import groupby, islice
from typing import Any

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.query import StreamingQuery

from caseflow.operators.cases import TRANSITIONS

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NEVER = 2**62
#: Rows of a key that are put away together.
CHUNK_ROWS = 10_000


class Fold:
    """What an operator does with a key's rows: ``empty`` is the state of a new key, ``step`` takes rows (time in milliseconds, then ``columns``) by time and then ``order`` and gives (state, rows of the result), and ``due`` says when, in
    milliseconds, the state changes without a row; ``lapse`` then gives what becomes of it."""

    columns: list[str] = []
    order: list[str] = []
    state: str = ""
    out: str = ""

    def empty(self) -> tuple:
        return ()

    def step(self, key: Any, rows: list[tuple], state: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def due(self, state: tuple) -> int:
        return NEVER

    def lapse(self, key: Any, state: tuple) -> tuple[tuple, list[tuple]]:
        return state, []


class InEventTime(StatefulProcessor):
    """Folds the rows of a key stretch by stretch of ``width`` milliseconds."""

    def __init__(self, fold: Fold, width: int, idle: int | None) -> None:
        self.fold, self.width, self.idle = fold, width, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.made = handle, Row(*[c.split()[0] for c in self.fold.out.split(", ")])
        self.held = handle.getValueState("held", f"upto long, {self.fold.state}")
        self.waiting = handle.getMapState("waiting", "stretch long", "parts array<binary>")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        stretches = set()
        while part := list(islice(rows, CHUNK_ROWS)):
            plain = sorted((tuple(r)[2:] for r in part), key=lambda r: r[0])
            for stretch, some in groupby(plain, key=lambda r: r[0] // self.width):
                known = list(self.waiting.getValue((stretch,))[0]) if self.waiting.containsKey((stretch,)) else []
                self.waiting.updateValue((stretch,), ([*known, bytearray(pickle.dumps(list(some)))],))
                stretches.add(stretch)
        if stretches:  # one timer for the earliest stretch; when it fires it sets the next one
            self.handle.registerTimer((min(stretches) + 1) * self.width)
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # whole stretches behind the watermark; all rows before it are in order then
        now = timerValues.getCurrentWatermarkInMs() // self.width * self.width
        fold, found, order = self.fold, [], [1 + self.fold.columns.index(c) for c in self.fold.order]
        upto, *state = self.held.get() if self.held.exists() else (0, *fold.empty())
        state = tuple(state)
        stretches = sorted(k[0] for k in self.waiting.keys())
        closed = [k for k in stretches if (k + 1) * self.width <= now]
        if stretches[len(closed) :]:
            self.handle.registerTimer((stretches[len(closed)] + 1) * self.width)
        for stretch in closed:
            rows = [row for part in self.waiting.getValue((stretch,))[0] for row in pickle.loads(bytes(part))]
            rows.sort(key=lambda row: (row[0], *((row[i] is None, row[i]) for i in order)))
            state, new = fold.step(key[0], rows, state)
            found += new
            self.waiting.removeKey((stretch,))
            upto = (stretch + 1) * self.width
        if fold.due(state) <= now:
            state, new = fold.lapse(key[0], state)
            found += new
        if self.idle is not None and upto + self.idle <= now and len(closed) == len(stretches):
            self.held.clear()
        elif closed or found:
            self.held.update((upto, *state))
            if now < fold.due(state) < NEVER:
                self.handle.registerTimer(-(-fold.due(state) // self.width) * self.width)
            if self.idle is not None and closed:
                self.handle.registerTimer(-(-(upto + self.idle) // self.width) * self.width)
        for row in found:
            yield self.made(*row)

    def close(self) -> None:
        pass


def _millis(text: str, spark) -> int:
    """The milliseconds of an interval like ``2 days``."""
    return int(spark.range(1).select(F.expr(f"unix_millis(timestamp'1970-01-01 00:00:00 UTC' + interval {text})")).first()[0])


def in_event_time(stream: DataFrame, fold: Fold, *, key: str, at: Column | str, delay: str, width: str, idle: str | None = None) -> DataFrame:
    """``fold`` over each key of ``stream`` in the order of ``at``, which is a timestamp; rows are waited for by ``delay`` and folded in stretches of ``width``.

    Rows without a time are left out, a null key is a key. Uses, and sets for the session where it is not set, the RocksDB state store.
    """
    spark = stream.sparkSession
    if "RocksDB" not in spark.conf.get(PROVIDER, ""):
        spark.conf.set(PROVIDER, ROCKSDB)
    rows = stream.withColumn("event_time", F.col(at) if isinstance(at, str) else at).where("event_time is not null").withWatermark("event_time", delay)
    rows = rows.select(F.col(key).alias("event_key"), "event_time", F.unix_millis("event_time").alias("event_ms"), *fold.columns)
    processor = InEventTime(fold, _millis(width, spark), None if idle is None else _millis(idle, spark))
    return rows.groupBy("event_key").transformWithState(processor, fold.out, "Append", "EventTime")


def late_rows(query: StreamingQuery) -> dict[int, int]:
    """Rows that came behind the watermark and were dropped, for each batch of a query that had any."""
    return {p["batchId"]: n for p in query.recentProgress if (n := sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"]))}


class Transitions(Fold):
    columns = order = ["seq", "status"]
    state = "seen boolean, status string"
    out = "case_id long, seq long, previous string, status string, allowed boolean"

    def empty(self) -> tuple:
        return False, None

    def step(self, key, rows, state):
        seen, before = state
        found = []
        for _, seq, now in rows:
            found.append((key, seq, before, now, not seen or before is None or now in TRANSITIONS.get(before, ())))
            seen, before = True, now
        return (seen, before), found


def timed_transitions(history: DataFrame, *, delay: str, width: str, idle: str | None = None) -> DataFrame:
    """(case_id, seq, previous, status, allowed) of a stream (case_id long, seq long, at timestamp, status string) by time, then seq: whether a status may follow the one before; first ones may."""
    return in_event_time(history, Transitions(), key="case_id", at="at", delay=delay, width=width, idle=idle)


class Attempts(Fold):
    columns, order = ["attempt_id", "result"], ["attempt_id"]
    state = "sequence long, counted long"
    out = "attempt_id long, sequence long, counted long, needs_human boolean"

    def __init__(self, cap: int) -> None:
        self.cap = cap

    def empty(self) -> tuple:
        return 0, 0

    def step(self, key, rows, state):
        sequence, counted = state
        found = []
        for _, attempt, result in rows:
            sequence, counted = sequence + 1, counted + (result != "ABORTED_NO_OUTPUT")
            found.append((attempt, sequence, counted, counted > self.cap))
        return (sequence, counted), found


def timed_attempts(attempts: DataFrame, *, cap: int = 2, delay: str, width: str, idle: str | None = None) -> DataFrame:
    """(attempt_id, sequence, counted, needs_human) of a stream (doc_id long, attempt_id long, started_at timestamp, result string); attempts without output are numbered but not counted."""
    return in_event_time(attempts, Attempts(cap), key="doc_id", at="started_at", delay=delay, width=width, idle=idle)


class Slots(Fold):
    columns, order = ["seq", "names", "vals"], ["seq"]
    state = "names array<string>, vals array<string>"
    out = "task_id long, seq long, names array<string>, vals array<string>"

    def empty(self) -> tuple:
        return [], []

    def step(self, key, rows, state):
        slots, found = dict(zip(*state, strict=True)), []
        for _, seq, names, vals in rows:
            slots |= {n: v for n, v in zip(names, vals, strict=True) if v is not None or n not in slots}
            found.append((key, seq, list(slots), list(slots.values())))
        return (list(slots), list(slots.values())), found


def timed_slots(saves: DataFrame, *, delay: str, width: str, idle: str | None = None) -> DataFrame:
    """(task_id, seq, slots) of a stream (task_id long, seq long, at timestamp, slots map<string,string>): the slots held after each save; null values keep what is stored."""
    none = F.array().cast("array<string>")
    rows = saves.select("task_id", "seq", "at", F.coalesce(F.map_keys("slots"), none).alias("names"), F.coalesce(F.map_values("slots"), none).alias("vals"))
    held = in_event_time(rows, Slots(), key="task_id", at="at", delay=delay, width=width, idle=idle)
    return held.select("task_id", "seq", F.map_from_arrays("names", "vals").alias("slots"))


class Deliveries(Fold):
    columns, order = ["action_id", "kind", "delivery_id", "expires"], ["action_id"]
    state = "delivery long, expires long, open boolean, used boolean"
    out = "doc_id long, action_id long, delivery_id long, outcome string"

    def empty(self) -> tuple:
        return None, None, False, False

    def due(self, state):
        return state[1] if state[2] and state[1] is not None else NEVER

    def lapse(self, key, state):
        delivery, expires, _, used = state
        return (delivery, expires, False, used), [(key, None, delivery, "lapsed")]

    def step(self, key, rows, state):
        found = []
        for at, action, kind, named, until in rows:
            if self.due(state) <= at:
                state, gone = self.lapse(key, state)
                found += gone
            delivery, expires, open_, used = state
            if kind == "issue":
                state, outcome = (named, until, True, False), "issued"
            elif kind != "consume":
                outcome = "invalid"
            elif delivery is None or named != delivery:
                outcome = "unknown"
            elif used:
                outcome = "already_consumed"
            elif not open_:
                outcome = "expired"
            else:
                state, outcome = (delivery, expires, False, True), "consumed"
            found.append((key, action, named, outcome))
        return state, found


def timed_deliveries(actions: DataFrame, *, delay: str, width: str, idle: str | None = None) -> DataFrame:
    """(doc_id, action_id, delivery_id, outcome) of a stream (doc_id long, action_id long, at timestamp, kind string, delivery_id long, expires_at timestamp) by time, then action.

    ``issue`` replaces whatever delivery the document had; ``consume`` gives consumed once, then already_consumed, expired from ``expires_at`` on (null: never) and unknown for a delivery that is
    not the newest. A delivery that nobody used or replaced in its time gives a row lapsed without an action, by a timer, when the watermark passes its end. Times count in milliseconds.
    """
    rows = actions.withColumn("expires", F.unix_millis(F.col("expires_at").cast("timestamp")))
    return in_event_time(rows, Deliveries(), key="doc_id", at="at", delay=delay, width=width, idle=idle)
