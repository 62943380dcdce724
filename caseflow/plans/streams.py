"""Registered streaming queries: each reads a whole table as a stream, runs it to its end and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.plans import registry
from caseflow.streaming import cases, timed
from caseflow.streaming.sinks import read_stream, run_available


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return read_stream(spark, path, spark.read.parquet(path).schema)


def _pick(names: list[str], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (key % len(names) + 1).cast("int"))


def stream_check_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _pick(["DRAFT", "NEEDS_INFO", "READY_FOR_REVIEW", "APPROVED", "IN_PROGRESS", "COMPLETED"], F.col("event_id"))
    history = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), status.alias("status"))
    found = run_available(cases.stream_check_transitions(history), "stream-transitions")
    return found.groupBy("previous", "status", "allowed").agg(F.count("*").alias("n"))


def stream_attempt_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _stream(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", "ABORTED_NO_OUTPUT").otherwise("OK").alias("result")
    )
    return run_available(cases.stream_attempt_cap(rows), "stream-attempts")


def stream_resume_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots of a user by event type; the slots held after each event, as JSON with names in order."""
    rows = _stream(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), F.create_map("event_type", F.col("event_id").cast("string")).alias("slots"))
    held = run_available(cases.stream_resume_slots(rows), "stream-slots")
    pairs = F.transform(F.array_sort(F.map_entries("slots")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return held.select("task_id", "seq", F.array_join(pairs, ",").alias("slots"))


def stream_one_time_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth event issues a delivery for 36 hours; the others consume the one their event id names."""
    key = F.col("event_id")
    rows = _stream(spark, sf_dir, "events").select(
        F.col("user_id").alias("doc_id"), key.alias("action_id"), F.col("ts").alias("at"), F.when(key % 5 == 0, "issue").otherwise("consume").alias("kind"), (key % 3).alias("delivery_id"), (F.col("ts") + F.expr("interval 36 hours")).alias("expires_at")
    )
    found = run_available(cases.stream_one_time_delivery(rows), "stream-deliveries")
    return found.groupBy("doc_id", "outcome").agg(F.count("*").alias("n"))


def stream_upsert_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _stream(spark, sf_dir, "events").select(F.concat_ws("/", "user_id", "event_type").alias("point_id"), F.col("ts").cast("timestamp").alias("ts"))
    return run_available(cases.stream_upsert_points(points, key="point_id", at="ts", delay="36500 days"), "stream-points").select("point_id")


def stream_trace_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    traces = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    found = run_available(cases.stream_trace_latency(traces, at="ts", branch="event_type", latency="value", width="1 day", delay="2 days"), "stream-latency")
    return found.select("branch", F.date_format("started", "yyyy-MM-dd").alias("day"), "n", "slowest")


#: What the registered streams in event time wait for, and the length of a stretch.
DESKS = 40
DAYS = {"delay": "2 days", "width": "10 days"}


def _timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by desk: state calls cost some milliseconds for each key of a batch, so all rows go to a few keys."""
    return _stream(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp")).withColumn("user_id", F.col("user_id") % DESKS)


def timed_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _pick(["DRAFT", "NEEDS_INFO", "READY_FOR_REVIEW", "APPROVED", "IN_PROGRESS", "COMPLETED"], F.col("event_id"))
    history = _timed_events(spark, sf_dir).select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), "at", status.alias("status"))
    found = run_available(timed.timed_transitions(history, **DAYS, idle="20 days"), "timed-transitions")
    return found.groupBy("previous", "status", "allowed").agg(F.count("*").alias("n"))


def timed_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = F.when(F.col("o_orderstatus") == "F", "ABORTED_NO_OUTPUT").otherwise("OK")
    rows = _stream(spark, sf_dir, "orders").select((F.col("o_custkey") % DESKS).alias("doc_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").cast("timestamp").alias("started_at"), result.alias("result"))
    return run_available(timed.timed_attempts(rows, delay="30 days", width="1000 days"), "timed-attempts")


def timed_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _timed_events(spark, sf_dir).select(F.col("user_id").alias("task_id"), F.col("event_id").alias("seq"), "at", F.create_map("event_type", F.col("event_id").cast("string")).alias("slots"))
    held = run_available(timed.timed_slots(rows, **DAYS), "timed-slots")
    pairs = F.transform(F.array_sort(F.map_entries("slots")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return held.select("task_id", "seq", F.array_join(pairs, ",").alias("slots"))


def timed_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("event_id")
    rows = _timed_events(spark, sf_dir).select(
        F.col("user_id").alias("doc_id"), key.alias("action_id"), "at", F.when(key % 5 == 0, "issue").otherwise("consume").alias("kind"), (key % 3).alias("delivery_id"), (F.col("at") + F.expr("interval 36 hours")).alias("expires_at")
    )
    found = run_available(timed.timed_deliveries(rows, **DAYS), "timed-deliveries")
    return found.groupBy("doc_id", "outcome").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (timed_transitions, timed_attempts, timed_slots, timed_deliveries, stream_check_transitions, stream_attempt_cap, stream_resume_slots, stream_one_time_delivery, stream_upsert_points, stream_trace_latency)}

#: Events in stretches that the watermark has closed.
_CLOSED = "hz as (select epoch_ms(max(ts) - interval 2 day) // 864000000 * 864000000 as h from events), ev as (select events.* replace (user_id % 40 as user_id) from events, hz where (epoch_ms(ts) // 864000000 + 1) * 864000000 <= h)"
ORACLE_SQL = {
    "timed_transitions": f"""with {_CLOSED}, s as (select *, ['DRAFT','NEEDS_INFO','READY_FOR_REVIEW','APPROVED','IN_PROGRESS','COMPLETED'][event_id % 6 + 1] as status from ev), p as (select status, lag(status) over (partition by user_id order by ts, event_id) as previous from s)
select previous, status, previous is null or (previous, status) in ({registry._NEXT}) as allowed, count(*) as n from p group by all""",
    "timed_attempts": """with hz as (select epoch_ms(max(o_orderdate) - interval 30 day) // 86400000000 * 86400000000 as h from orders), o as (select orders.* replace (o_custkey % 40 as o_custkey) from orders, hz where (epoch_ms(o_orderdate::timestamp) // 86400000000 + 1) * 86400000000 <= h)
select o_orderkey as attempt_id, row_number() over w as sequence, (sum((o_orderstatus != 'F')::int) over w)::bigint as counted, sum((o_orderstatus != 'F')::int) over w > 2 as needs_human from o window w as (partition by o_custkey order by o_orderdate, o_orderkey)""",
    "timed_slots": f"""with {_CLOSED}, t as (select distinct event_type from events), h as (select e.user_id, e.event_id, t.event_type, last_value(case when e.event_type = t.event_type then e.event_id end ignore nulls) over (partition by e.user_id, t.event_type order by e.ts, e.event_id) as held from ev e cross join t)
select user_id as task_id, event_id as seq, string_agg(event_type || '=' || held, ',' order by event_type) filter (where held is not null) as slots from h group by all""",
    "timed_deliveries": f"""with {_CLOSED}, a as (select user_id as d, event_id as i, ts as t, event_id % 5 = 0 as issue, event_id % 3 as k from ev),
g as (select *, sum(issue::int) over (partition by d order by t, i) as run from a),
f as (select *, first_value(k) over w as k0, first_value(t) over w + interval 36 hour as until from g window w as (partition by d, run order by t, i)),
c as (select *, not issue and run > 0 and k = k0 and t < until as good from f),
u as (select *, max(good::int) over (partition by d, run order by t, i rows between unbounded preceding and 1 preceding) as used from c),
r as (select d, run, any_value(until) as until, bool_or(good) as used, min(t) as t from c where run > 0 group by 1, 2), n as (select *, lead(t) over (partition by d order by run) as next from r)
select d as doc_id, outcome, count(*) as n from (select d, case when issue then 'issued' when run = 0 or k != k0 then 'unknown' when used = 1 then 'already_consumed' when good then 'consumed' else 'expired' end as outcome from u
  union all select d, 'lapsed' from n, hz where not used and epoch_ms(until) <= h and (next is null or until <= next)) group by all""",
    "stream_check_transitions": registry.ORACLE_SQL["check_transitions"],
    "stream_attempt_cap": registry.ORACLE_SQL["attempt_sequence"],
    "stream_upsert_points": "select distinct user_id || '/' || event_type as point_id from events",
    "stream_trace_latency": """select event_type as branch, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as n, max(value) as slowest from events
  group by all having date_trunc('day', min(ts)) + interval 1 day <= (select max(ts) from events) - interval 2 day""",
    "stream_resume_slots": """with t as (select distinct event_type from events), e as (select user_id, event_id from events),
h as (select e.user_id, e.event_id, t.event_type, max(case when x.event_type = t.event_type then x.event_id end) over (partition by e.user_id, t.event_type order by e.event_id) as held
  from e cross join t join events x on x.event_id = e.event_id)
select user_id as task_id, event_id as seq, string_agg(event_type || '=' || held, ',' order by event_type) filter (where held is not null) as slots from h group by all""",
    "stream_one_time_delivery": """with a as (select user_id as d, event_id as i, ts as t, event_id % 5 = 0 as issue, event_id % 3 as k from events),
g as (select *, sum(issue::int) over (partition by d order by t, i) as run from a),
f as (select *, first_value(k) over w as k0, first_value(t) over w + interval 36 hour as until from g window w as (partition by d, run order by t, i)),
c as (select *, not issue and run > 0 and k = k0 and t < until as good from f),
u as (select *, row_number() over (partition by d, run, good order by t, i) as nth, max(good::int) over (partition by d, run order by t, i rows between unbounded preceding and 1 preceding) as used from c)
select d as doc_id, case when issue then 'issued' when run = 0 or k != k0 then 'unknown' when used = 1 then 'already_consumed' when good then 'consumed' else 'expired' end as outcome, count(*) as n from u group by all""",
}
