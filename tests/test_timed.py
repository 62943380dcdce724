"""Streams in event time: order across batches, late rows, timers that end deliveries, keys that are forgotten, and a hot key."""

import datetime as dt
import os

import pytest
from pyspark.sql.types import StructType

from caseflow.sources.shared import fresh_path
from caseflow.streaming import timed
from caseflow.streaming.sinks import read_stream, run_available

DAY = [dt.datetime(2024, 1, d, tzinfo=dt.UTC) for d in range(1, 32)]
WAIT = {"delay": "1 day", "width": "1 day"}


@pytest.fixture
def stream(spark, tmp_path):
    """A stream over given batches, one file each, in order."""

    def make(schema, *batches):
        folder = tmp_path / "in"
        folder.mkdir()
        for at, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"b{at}"))
            (part,) = (tmp_path / f"b{at}").glob("part-*.parquet")
            (folder / f"{at}.parquet").write_bytes(part.read_bytes())
            os.utime(folder / f"{at}.parquet", (1000 + at, 1000 + at))
        return read_stream(spark, str(folder), StructType(spark.createDataFrame([], schema).schema.fields), files_per_batch=1)

    return make


HISTORY = "case_id long, seq long, at timestamp, status string"


def test_rows_are_folded_by_time_whatever_batch_they_come_in(stream):
    first = [(1, 2, DAY[2], "NEEDS_INFO"), (None, 1, DAY[1], "DRAFT"), (1, 9, None, "DRAFT")]
    second = [(1, 1, DAY[1], "DRAFT"), (1, 3, DAY[3], "COMPLETED"), (None, 2, DAY[3], None), (3, 1, DAY[9], "DRAFT")]
    found = run_available(timed.timed_transitions(stream(HISTORY, first, second, [(3, 2, DAY[20], "DRAFT")]), **WAIT), "timed")
    assert {tuple(r) for r in found.collect()} == {(1, 1, None, "DRAFT", True), (1, 2, "DRAFT", "NEEDS_INFO", True), (1, 3, "NEEDS_INFO", "COMPLETED", False), (None, 1, None, "DRAFT", True), (None, 2, "DRAFT", None, False), (3, 1, None, "DRAFT", True)}


def test_rows_behind_the_watermark_are_counted(spark, stream):
    rows = timed.timed_transitions(stream(HISTORY, [(1, 5, DAY[10], "DRAFT")], [(1, 6, DAY[20], "DRAFT")], [(1, 1, DAY[1], "DRAFT"), (2, 1, DAY[2], "DRAFT"), (1, 7, DAY[25], "DRAFT")]), **WAIT)
    root = fresh_path(spark, "late")
    query = rows.writeStream.format("parquet").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start(f"{root}/rows")
    query.awaitTermination()
    assert sum(timed.late_rows(query).values()) == 2
    assert sorted(r["seq"] for r in spark.read.parquet(f"{root}/rows").collect()) == [5, 6]


def test_a_forgotten_key_starts_anew(stream):
    batches = [(1, 1, DAY[1], "DRAFT")], [(2, 1, DAY[12], "DRAFT")], [(2, 2, DAY[13], "DRAFT")], [(1, 2, DAY[14], "COMPLETED")], [(2, 3, DAY[25], "DRAFT")]
    found = run_available(timed.timed_transitions(stream(HISTORY, *batches), **WAIT, idle="5 days"), "idle")
    allowed = {(r["case_id"], r["seq"]): (r["previous"], r["allowed"]) for r in found.collect()}
    assert allowed[1, 2] == (None, True)  # after five days the first status is forgotten


def test_a_remembered_key_goes_on(stream):
    batches = [(1, 1, DAY[1], "DRAFT")], [(2, 1, DAY[12], "DRAFT")], [(2, 2, DAY[13], "DRAFT")], [(1, 2, DAY[14], "COMPLETED")], [(2, 3, DAY[25], "DRAFT")]
    found = run_available(timed.timed_transitions(stream(HISTORY, *batches), **WAIT), "kept")
    assert [(r["previous"], r["allowed"]) for r in found.where("case_id = 1 and seq = 2").collect()] == [("DRAFT", False)]


def test_attempts_and_slots(stream):
    attempts = stream("doc_id long, attempt_id long, started_at timestamp, result string", [(1, 2, DAY[2], "ABORTED_NO_OUTPUT"), (1, 1, DAY[1], "OK")], [(1, 4, DAY[4], "OK"), (1, 3, DAY[3], None), (2, 5, DAY[20], "OK")])
    assert sorted(map(tuple, run_available(timed.timed_attempts(attempts, delay="3 days", width="1 day"), "a").collect())) == [(1, 1, 1, False), (2, 2, 1, False), (3, 3, 2, False), (4, 4, 3, True)]


def test_slots(stream):
    saves = stream("task_id long, seq long, at timestamp, slots map<string,string>", [(1, 1, DAY[1], {"a": "x", "b": None}), (1, 2, DAY[1], None)], [(1, 3, DAY[3], {"a": None, "b": "y"}), (2, 1, DAY[20], {})])
    assert sorted(((r["task_id"], r["seq"], r["slots"]) for r in run_available(timed.timed_slots(saves, **WAIT), "s").collect()), key=str) == [(1, 1, {"a": "x", "b": None}), (1, 2, {"a": "x", "b": None}), (1, 3, {"a": "x", "b": "y"})]


def test_a_delivery_expires_by_itself(stream):
    schema = "doc_id long, action_id long, at timestamp, kind string, delivery_id long, expires_at timestamp"
    first = [(1, 1, DAY[1], "issue", 7, DAY[5]), (2, 1, DAY[1], "issue", 8, DAY[5]), (2, 2, DAY[2], "consume", 8, None), (3, 1, DAY[1], "issue", 9, None), (4, 1, DAY[1], "issue", 6, DAY[5]), (4, 2, DAY[5], "consume", 6, None), (5, 1, DAY[1], "issue", 5, DAY[5]), (5, 2, DAY[2], "issue", 4, DAY[9])]
    second = [(9, 1, DAY[7], "odd", 1, None), (2, 3, DAY[7], "consume", 8, None), (9, 2, DAY[8], "consume", 1, None)]
    # nothing is said of documents 1 and 5 after the first batch; only time goes on
    found = run_available(timed.timed_deliveries(stream(schema, first, second, [(9, 3, DAY[20], "odd", 1, None)]), **WAIT), "d")
    got = sorted(((r["doc_id"], r["action_id"] or 99, r["delivery_id"], r["outcome"]) for r in found.collect()))
    assert got == [
        (1, 1, 7, "issued"), (1, 99, 7, "lapsed"), (2, 1, 8, "issued"), (2, 2, 8, "consumed"), (2, 3, 8, "already_consumed"), (3, 1, 9, "issued"), (4, 1, 6, "issued"), (4, 2, 6, "expired"), (4, 99, 6, "lapsed"),
        (5, 1, 5, "issued"), (5, 2, 4, "issued"), (5, 99, 4, "lapsed"), (9, 1, 1, "invalid"), (9, 2, 1, "unknown"),
    ]


def test_a_hot_key_is_folded_stretch_by_stretch(spark, stream):
    """100,000 rows of one key in one batch: no step of the fold gets more than a stretch of them."""
    from pyspark.sql import functions as F

    class Sizes(timed.Fold):
        columns, order, state, out = ["seq"], ["seq"], "n long", "case_id long, rows long, first long"

        def empty(self):
            return (0,)

        def step(self, key, rows, state):
            return (state[0] + len(rows),), [(key, len(rows), state[0])]

    source = stream("case_id long, seq long, at timestamp", [(1, 0, DAY[0])])
    hot = source.select("case_id", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(100_000).cast("long"))).alias("seq"), "at").withColumn("at", F.col("at") + F.make_dt_interval(secs=F.col("seq").cast("decimal(18,6)") * 20))
    found = run_available(timed.in_event_time(hot, Sizes(), key="case_id", at="at", delay="1 day", width="6 hours"), "hot").collect()
    assert max(r["rows"] for r in found) <= 6 * 3600 // 20 + 1 and sum(r["rows"] for r in found) > 90_000
    ahead = 0
    for r in sorted(found, key=lambda r: r["first"]):
        assert r["first"] == ahead
        ahead += r["rows"]
