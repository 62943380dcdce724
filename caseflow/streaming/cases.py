"""Cases as streams: status histories, capped attempts, resumed slots, one-time deliveries, idempotent upserts, latencies.

Operators that need the rows of a key in order take a key's rows of one micro-batch together and sort them, so a result
does not depend on how rows arrive inside a batch; across batches, the rows of a key must arrive in order. Up to 64 neighbouring
keys are taken in one call, as a call costs milliseconds. What a task holds of them is bounded by the size of a batch
(``files_per_batch`` of ``read_stream``); state is a few values for each key. Null keys are a key of their own, empty input
gives no rows, columns that are not named are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseflow.operators.cases import TRANSITIONS


#: Neighbouring keys of one call, as a power of two.
KEY_BITS = 6


def _in_order(stream: DataFrame, key: str, order: list[str], step: Callable, out: str, state: dict[str, str]) -> DataFrame:
    """Folds ``step(rows of a key sorted by order, its state or None) -> (result rows, state)`` over the micro-batches; rows are tuples, and ``key`` is a whole number."""
    columns, results = stream.columns, [c.split()[0] for c in out.split(", ")]

    def fold(_, parts: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts), ignore_index=True)
        if len(rows):
            rows = rows.sort_values([key, *order], kind="stable", ignore_index=True)
            kept = {k: values for k, *values in zip(*held.get, strict=True)} if held.exists else {}
            found = []
            keys = (None if pd.isna(k) else int(k) for k in rows[key])
            for k, own in groupby(zip(keys, zip(*(rows[c].tolist() for c in columns), strict=True), strict=True), lambda pair: pair[0]):
                more, kept[k] = step([row for _, row in own], kept.get(k))
                found += more
            held.update((list(kept), *map(list, zip(*kept.values(), strict=True))))
            yield pd.DataFrame(found, columns=results)

    near = stream.withColumn("__near", F.shiftright(key, KEY_BITS))
    held = ", ".join(["keys array<long>", *[f"{name} array<{kind}>" for name, kind in state.items()]])
    return near.groupBy("__near").applyInPandasWithState(fold, out, held, "append", GroupStateTimeout.NoTimeout)


def stream_check_transitions(history: DataFrame) -> DataFrame:
    """(case_id, seq, previous, status, allowed, late) for a stream of (case_id long, seq long, status string).

    First statuses are allowed, null and unknown ones are not when they follow. Late rows have no previous status and
    leave the state as it is; their ``allowed`` is null. Rows of one case should not share a seq; if so, statuses go by alphabet.
    """

    def step(rows: list[tuple], kept: list | None) -> tuple[list[tuple], tuple]:
        seen, last, status = kept or (False, None, None)
        found = []
        for case, seq, now in rows:
            now = now if isinstance(now, str) else None
            late = pd.isna(seq) or (last is not None and seq < last)
            found.append((case, seq, None if late else status, now, None if late else not seen or status is None or now in TRANSITIONS.get(status, ()), late))
            if not late:
                seen, last, status = True, int(seq), now
        return found, (seen, last, status)

    rows = history.select("case_id", "seq", "status")
    return _in_order(rows, "case_id", ["seq", "status"], step, "case_id long, seq long, previous string, status string, allowed boolean, late boolean", {"seen": "boolean", "last": "long", "status": "string"})


def stream_attempt_cap(attempts: DataFrame, *, cap: int = 2) -> DataFrame:
    """(attempt_id, sequence, counted, needs_human) for a stream of (doc_id long, attempt_id long, started_at timestamp, result string).

    Attempts without output (``ABORTED_NO_OUTPUT``) are numbered but not counted; beyond ``cap`` counted ones a person decides.
    A null result counts.
    """

    def step(rows: list[tuple], kept: list | None) -> tuple[list[tuple], tuple]:
        sequence, counted = kept or (0, 0)
        found = []
        for _, attempt, _, result in rows:
            sequence, counted = sequence + 1, counted + (result != "ABORTED_NO_OUTPUT")
            found.append((attempt, sequence, counted, counted > cap))
        return found, (sequence, counted)

    rows = attempts.select("doc_id", "attempt_id", F.col("started_at").cast("timestamp").alias("started_at"), "result")
    return _in_order(rows, "doc_id", ["started_at", "attempt_id"], step, "attempt_id long, sequence long, counted long, needs_human boolean", {"sequence": "long", "counted": "long"})


def stream_resume_slots(saves: DataFrame) -> DataFrame:
    """(task_id, seq, slots) for a stream of (task_id long, seq long, slots map<string,string>): the slots held after each save, new ones over stored ones.

    A null or empty map changes nothing; a slot saved as null keeps its stored value.
    """

    def step(rows: list[tuple], kept: list | None) -> tuple[list[tuple], tuple]:
        slots, found = dict(zip(*kept, strict=True)) if kept else {}, []
        for task, seq, new in rows:
            pairs = new.items() if isinstance(new, dict) else new if new is not None else ()
            slots |= {name: value for name, value in pairs if value is not None or name not in slots}
            found.append((task, seq, dict(slots)))
        return found, (list(slots), list(slots.values()))

    rows = saves.select("task_id", "seq", "slots")
    return _in_order(rows, "task_id", ["seq"], step, "task_id long, seq long, slots map<string,string>", {"names": "array<string>", "vals": "array<string>"})


def stream_one_time_delivery(actions: DataFrame) -> DataFrame:
    """(doc_id, action_id, outcome) for a stream of (doc_id long, action_id long, at timestamp, kind string, delivery_id long, expires_at timestamp).

    ``issue`` replaces whatever delivery the document had. ``consume`` gives ``consumed`` once, then ``already_consumed``;
    ``expired`` from ``expires_at`` on (null: never) and ``unknown`` for a delivery that is not the document's newest. Other kinds are ``invalid``.
    """

    def step(rows: list[tuple], kept: list | None) -> tuple[list[tuple], tuple]:
        delivery, expires, used = kept or (None, None, False)
        found = []
        for doc, action, at, kind, asked, until in rows:
            if kind == "issue":
                delivery, expires, used = asked, None if pd.isna(until) else int(until), False
                outcome = "issued"
            elif kind != "consume":
                outcome = "invalid"
            elif delivery is None or asked != delivery:
                outcome = "unknown"
            elif used:
                outcome = "already_consumed"
            elif expires is not None and at >= expires:
                outcome = "expired"
            else:
                outcome, used = "consumed", True
            found.append((doc, action, outcome))
        return found, (None if pd.isna(delivery) else int(delivery), expires, used)

    micros = {name: F.unix_micros(F.col(column).cast("timestamp")) for name, column in (("at_us", "at"), ("expires_us", "expires_at"))}
    rows = actions.select("doc_id", "action_id", micros["at_us"].alias("at_us"), "kind", "delivery_id", micros["expires_us"].alias("expires_at"))
    return _in_order(rows, "doc_id", ["at_us", "action_id"], step, "doc_id long, action_id long, outcome string", {"delivery": "long", "expires": "long", "used": "boolean"})


def stream_upsert_points(points: DataFrame, *, key: str, at: str, delay: str) -> DataFrame:
    """The stream with one row of each ``key``: repeats that come within ``delay`` of the first are left out, so that publishing again changes nothing."""
    return points.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def stream_trace_latency(traces: DataFrame, *, at: str, branch: str, latency: str, width: str, delay: str) -> DataFrame:
    """(branch, started, n, slowest, p50, p95) of each tumbling window that the watermark has closed; null latencies count in n alone."""
    window = F.window(at, width)
    found = traces.withWatermark(at, delay).groupBy(window.alias("w"), F.col(branch).alias("branch"))
    quantile = [F.percentile_approx(latency, p, 10000).alias(name) for name, p in (("p50", 0.5), ("p95", 0.95))]
    return found.agg(F.count("*").alias("n"), F.max(latency).alias("slowest"), *quantile).select("branch", F.col("w.start").alias("started"), "n", "slowest", "p50", "p95")
