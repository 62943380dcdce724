import datetime as dt
import os

import pytest
from pyspark.sql.types import StructType

from caseflow.streaming import cases
from caseflow.streaming.sinks import read_stream, run_available


@pytest.fixture
def stream(spark, tmp_path):
    """A stream over given batches, one file each, in order."""

    def make(schema, *batches):
        folder = tmp_path / "in"
        folder.mkdir()
        frame = spark.createDataFrame([], schema)
        for at, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{at}"))
            (part,) = (tmp_path / f"b{at}").glob("part-*.parquet")
            target = folder / f"{at}.parquet"
            target.write_bytes(part.read_bytes())
            os.utime(target, (1000 + at, 1000 + at))
        if not batches:
            frame.write.mode("overwrite").parquet(str(folder))
        return read_stream(spark, str(folder), StructType(frame.schema.fields), files_per_batch=1)

    return make


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_transitions_keep_their_state_between_batches_and_mark_late_rows(stream):
    schema = "case_id long, seq long, status string, previous int"
    first = [(1, 2, "NEEDS_INFO", 0), (1, 1, "DRAFT", 0), (None, 1, "DRAFT", 0), (2, 1, None, 0)]
    found = run_available(cases.stream_check_transitions(stream(schema, first, [(1, 3, "COMPLETED", 0), (1, 1, "DRAFT", 0), (2, 2, "DRAFT", 0), (None, 2, "odd", 0), (1, None, "DRAFT", 0)])), "t")
    assert set(rows_of(found, "case_id")) == {
        (None, 1, None, "DRAFT", True, False), (None, 2, "DRAFT", "odd", False, False), (1, 1, None, "DRAFT", True, False), (1, 2, "DRAFT", "NEEDS_INFO", True, False),
        (1, 3, "NEEDS_INFO", "COMPLETED", False, False), (1, 1, None, "DRAFT", None, True), (1, None, None, "DRAFT", None, True), (2, 1, None, None, True, False), (2, 2, None, "DRAFT", True, False),
    }


def test_attempts_beyond_the_cap_go_to_a_person(stream):
    day = [dt.datetime(2024, 1, d) for d in range(1, 6)]
    schema = "doc_id long, attempt_id long, started_at timestamp, result string"
    first = [(1, 2, day[1], "ABORTED_NO_OUTPUT"), (1, 1, day[0], "OK")]
    found = run_available(cases.stream_attempt_cap(stream(schema, first, [(1, 3, day[2], None), (1, 4, day[3], "OK"), (2, 5, day[4], "OK")])), "a")
    assert rows_of(found, "attempt_id") == [(1, 1, 1, False), (2, 2, 1, False), (3, 3, 2, False), (4, 4, 3, True), (5, 1, 1, False)]


def test_resumed_slots(stream):
    schema = "task_id long, seq long, slots map<string,string>"
    found = run_available(cases.stream_resume_slots(stream(schema, [(1, 1, {"a": "x", "b": None}), (1, 2, None)], [(1, 3, {"a": None, "b": "y"}), (2, 1, {})])), "s")
    assert rows_of(found, "task_id", "seq") == [(1, 1, {"a": "x", "b": None}), (1, 2, {"a": "x", "b": None}), (1, 3, {"a": "x", "b": "y"}), (2, 1, {})]


def test_deliveries_are_used_once_and_expire(stream):
    hour = [dt.datetime(2024, 1, 1, h) for h in range(9)]
    schema = "doc_id long, action_id long, at timestamp, kind string, delivery_id long, expires_at timestamp"
    first = [(1, 0, hour[0], "consume", 7, None), (1, 1, hour[1], "issue", 7, hour[4]), (1, 2, hour[2], "consume", 7, None), (1, 3, hour[3], "consume", 7, None)]
    second = [(1, 4, hour[4], "issue", 8, hour[5]), (1, 5, hour[5], "consume", 8, None), (1, 6, hour[6], "consume", 7, None), (1, 7, hour[7], "issue", 9, None), (1, 8, hour[8], "consume", 9, None), (1, 9, hour[8], None, 9, None)]
    found = run_available(cases.stream_one_time_delivery(stream(schema, first, second)), "d")
    assert [o for _, _, o in rows_of(found, "action_id")] == ["unknown", "issued", "consumed", "already_consumed", "issued", "expired", "unknown", "issued", "consumed", "invalid"]


def test_upserts_repeat_nothing_and_windows_close_behind_the_watermark(stream):
    day = [dt.datetime(2024, 1, d) for d in (1, 1, 2, 9)]
    schema = "k string, ts timestamp, v double"
    source = stream(schema, [("a", day[0], 1.0), ("a", day[1], None), ("b", day[2], 3.0)], [("a", day[3], 5.0)])
    assert rows_of(run_available(cases.stream_upsert_points(source, key="k", at="ts", delay="100 days"), "u").select("k"), "k") == [("a",), ("b",)]
    closed = run_available(cases.stream_trace_latency(source, at="ts", branch="k", latency="v", width="1 day", delay="1 day"), "w")
    assert rows_of(closed.drop("started"), "branch") == [("a", 2, 1.0, 1.0, 1.0), ("b", 1, 3.0, 3.0, 3.0)]


def test_empty_tables(stream):
    assert run_available(cases.stream_check_transitions(stream("case_id long, seq long, status string")), "e").count() == 0


def test_neighbouring_keys_share_a_call_and_keep_their_own_state(stream):
    schema = "doc_id long, attempt_id long, started_at timestamp, result string"
    at = dt.datetime(2026, 1, 1)
    keys = [*range(-70, 70), 2**53, 2**53 + 1, None]
    batch = lambda n: [(k, (i * 10 + n), at + dt.timedelta(days=n), "ABORTED_NO_OUTPUT" if i % 2 and n == 0 else "OK") for i, k in enumerate(keys)]
    found = cases.stream_attempt_cap(stream(schema, batch(0), batch(1), batch(2)), cap=2)
    assert "__near" in found._jdf.queryExecution().analyzed().toString()  # one call for up to 64 keys, not one for each
    rows = rows_of(run_available(found, "near"), "attempt_id")
    assert rows == [(i * 10 + n, n + 1, n + (i % 2 == 0), n + (i % 2 == 0) > 2) for i in range(len(keys)) for n in range(3)]
