"""Queries of audits with state or several inputs: saved identities, resumed cases, decisions, plans, reviews, options; and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.operators import audit, cases, records, slots
from caseflow.plans.common import joined, pick, table
from caseflow.sources.shared import fresh_path


def _shown(slots_map: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.map_entries(slots_map)), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("null")))), ";")


def identity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saves of all events in two runs, read back from the audit table: the workers' slots and how many saves of each are kept."""
    root, events = fresh_path(spark, "identity"), table(spark, sf_dir, "events")
    saves = events.select(F.col("user_id").alias("worker_id"), F.lit(None).cast("long").alias("task_id"), F.col("event_id").alias("seq"), F.create_map("event_type", F.col("event_id").cast("string")).alias("slots"))
    for part in (0, 1):
        slots.save_identity_slots(saves.where(F.col("seq") % 2 == part), root)
    workers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("worker_id"), F.create_map(F.lit("name"), F.col("c_name")).alias("slots"))
    kept = spark.read.schema(slots.SAVES).parquet(f"{root}/identity-saves").groupBy("worker_id").agg(F.count("*").alias("n"))
    return slots.saved_workers(spark, root, workers).join(kept, "worker_id", "left").select("worker_id", _shown(F.col("slots")).alias("slots"), F.coalesce("n", F.lit(0)).alias("n_saves"))


def resume_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as stored cases, their newest orders as updates."""
    key = F.col("c_custkey")
    stored = table(spark, sf_dir, "customer").select(
        key.alias("task_id"), F.col("c_mktsegment").alias("instruction"), F.create_map(F.lit("a"), F.col("c_name"), F.lit("b"), F.lit("old")).alias("slots"), key.cast("string").alias("worker_id"),
        F.when(key % 2 == 0, F.lit("c2")).alias("company_id"), pick(["RENEWAL", None], key).alias("intent"), F.lit("wf").alias("workflow_id"), F.lit(None).cast("string").alias("ocr_result"),
    )
    newest = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("task_id")).agg(F.max("o_orderkey").alias("o"))
    o = F.col("o")
    update = newest.select(
        "task_id", pick(["", "new", None], o).alias("instruction"), F.create_map(F.lit("b"), F.when(o % 5 != 0, o.cast("string"))).alias("slots"), F.when(o % 4 != 0, F.array(o.cast("string"))).alias("documents"),
        F.when(o % 3 == 0, F.lit("w")).alias("worker_id"), F.lit(None).cast("string").alias("company_id"),
    )
    found = cases.resume_cases(stored, update)
    return found.select("task_id", "instruction", _shown(F.col("slots")).alias("slots"), joined("documents").alias("documents"), "worker_id", "company_id", "intent", "workflow_id", "ocr_result")


def check_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as reviews, their lines as judged fields."""
    lines = table(spark, sf_dir, "lineitem").where("l_orderkey % 3 != 0")
    verdict = F.when(F.col("l_quantity") > 49, "FAIL").when(F.col("l_quantity") > 40, "NEEDS_HUMAN").otherwise("PASS")
    fields = lines.select(F.col("l_orderkey").alias("review_id"), (F.col("l_partkey") % 40).alias("field_id"), verdict.alias("verdict"), F.concat(F.lit(" "), "l_returnflag").alias("reason"))
    extra = table(spark, sf_dir, "orders").where("o_orderkey % 5 = 0").select(F.col("o_orderkey").alias("review_id"), F.lit(99).cast("long").alias("field_id"))
    expected = fields.select("review_id", "field_id").unionByName(extra)
    decisions = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("review_id"), pick(["PASS", "FAIL", "NEEDS_HUMAN", None], F.col("o_orderkey")).alias("verdict"))
    return audit.check_decisions(decisions, fields, expected)


def verify_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans for all documents; some name no file, another text, or were altered."""
    d, docs = F.col("doc_id"), table(spark, sf_dir, "documents")
    path = F.concat(F.lit('a"b/'), F.when(d % 11 == 0, "none").otherwise(d.cast("string")))
    digest = F.sha2(F.when(d % 7 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")), 256)
    said = F.format_string('{"dispositions":{},"document_sha256":"%s","input_path":"a\\"b/%s","operations":[{"n":%d}],"version":1}', digest, F.when(d % 11 == 0, "none").otherwise(d.cast("string")), d)
    plans = docs.select(F.sha2(said, 256).alias("plan_id"), F.lit(1).alias("version"), path.alias("input_path"), digest.alias("document_sha256"), F.format_string('[{"n":%d}]', F.when(d % 5 == 0, d + 1).otherwise(d)).alias("operations"), F.lit("{}").alias("dispositions"))
    files = docs.select(F.concat(F.lit('a"b/'), d.cast("string")).alias("path"), F.encode("text", "UTF-8").alias("content"))
    return audit.verify_plans(plans, files)


def verify_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as reviews of three images each."""
    p, pages = F.col("page_id"), table(spark, sf_dir, "pages")
    image = lambda i: F.struct(F.concat_ws("/", p.cast("string"), F.lit(i)).alias("uri"), F.sha2(F.concat("html", F.lit(i)), 256).alias("sha256"))
    stored = pages.select(F.explode(F.array(*map(image, "012"))).alias("i"), p).select("i.uri", F.when((p % 7 == 0) & F.col("i.uri").endswith("/1"), "other").otherwise(F.col("i.sha256")).alias("sha256")).where(~((p % 11 == 0) & F.col("uri").endswith("/2")))
    ids = lambda k: F.when(p % k == 0, F.array(F.lit("a"), F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))
    reviews = pages.select(F.sha2("url", 256).alias("review_id"), F.sha2(F.when(p % 13 == 0, "html").otherwise(F.col("url")), 256).alias("digest"), ids(3).alias("view_ids"), ids(5).alias("field_ids"), F.array(*map(image, "012")).alias("images"))
    return audit.verify_reviews(reviews, stored)


def application_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of an order's form; two options for each order."""
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("row")).agg(F.min("l_partkey").alias("p"), F.sum("l_quantity").cast("long").alias("q"))
    texts = F.array(pick(["[ ] yes", "no", "[  ] Maybe"], F.col("p")), F.when(F.col("q") % 2 == 0, "(희망  자격: 희망 자격 : old)").otherwise("x"))
    cells = lines.select("doc_id", F.lit(0).alias("table_id"), "row", F.posexplode(texts).alias("column", "text"))
    option = F.explode(F.array(F.struct(F.lit("Yes!").alias("label"), F.when(F.col("doc_id") % 2 == 1, "F-2$1").alias("value")), F.struct(F.lit("N o").alias("label"), F.lit("E-9").alias("value"))))
    options = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id")).select("doc_id", option.alias("o")).select("doc_id", "o.*")
    return records.apply_application_options(cells, options).select("doc_id", "row", F.col("column").cast("long").alias("column"), "text")


QUERIES = {f.__name__: f for f in (identity_audit, resume_cases, check_decisions, verify_plans, verify_reviews, application_options)}

ORACLE_SQL = {
    "identity_audit": "with s as (select user_id as w, event_type as k, max(event_id)::varchar as v from events group by 1, 2), a as (select * from s union all select c_custkey, 'name', c_name from customer), n as (select user_id as w, count(*) as n from events group by 1) select c_custkey as worker_id, (select string_agg(k || '=' || v, ';' order by k) from a where w = c_custkey) as slots, coalesce(n, 0) as n_saves from customer left join n on w = c_custkey",
    "resume_cases": """with u as (select o_custkey as t, max(o_orderkey) as o from orders group by 1), b as (select * from customer full outer join u on t = c_custkey)
select coalesce(t, c_custkey) as task_id, case when o % 3 = 1 then 'new' else coalesce(c_mktsegment, '') end as instruction, concat_ws(';', 'a=' || c_name, case when t is null then 'b=old' when o % 5 = 0 then 'b=null' else 'b=' || o end) as slots, case when o % 4 != 0 then o::varchar else '' end as documents,
  case when o % 3 = 0 then 'w' else c_custkey::varchar end as worker_id, case when c_custkey % 2 = 0 then 'c2' end as company_id, case when c_custkey % 2 = 0 then 'RENEWAL' else '' end as intent, case when c_custkey is null then '' else 'wf' end as workflow_id, null as ocr_result from b""",
    "check_decisions": """with f as (select l_orderkey as r, l_partkey % 40 as f, l_quantity as q, l_returnflag as reason from lineitem where l_orderkey % 3 != 0), j as (select r, max(q) as q, count(*) as n, count(distinct f) as ids, count(distinct reason) as reasons from f group by 1),
v as (select o_orderkey as review_id, j.*, case when q > 49 then 'FAIL' when q > 40 then 'NEEDS_HUMAN' else 'PASS' end as field_verdict, ['PASS', 'FAIL', 'NEEDS_HUMAN', null][o_orderkey % 4 + 1] as given from orders left join j on r = o_orderkey)
select review_id, field_verdict, case when n > ids then 'DUPLICATE_FIELD' when review_id % 5 = 0 then 'OTHER_FIELDS' when n > 1 and reasons = 1 then 'SAME_REASON' when given is null or given != field_verdict then 'OTHER_VERDICT' end as error from v""",
    "verify_plans": r"""select sha256('{"dispositions":{},"document_sha256":"' || sha256(case when doc_id % 7 = 0 then text || 'x' else text end) || '","input_path":"a\"b/' || case when doc_id % 11 = 0 then 'none' else doc_id::varchar end || '","operations":[{"n":' || doc_id || '}],"version":1}') as plan_id,
  case when doc_id % 11 = 0 then 'FILE_MISSING' when doc_id % 7 = 0 then 'DOCUMENT_CHANGED' when doc_id % 5 = 0 then 'PLAN_ALTERED' end as error from documents""",
    "verify_reviews": "select sha256(url) as review_id, case when page_id % 13 = 0 then 'REVIEW_ALTERED' when page_id % 3 = 0 then 'DUPLICATE_VIEW' when page_id % 5 = 0 then 'DUPLICATE_FIELD' when page_id % 7 = 0 or page_id % 11 = 0 then 'IMAGE_ALTERED' end as error from pages",
    "application_options": """with l as (select l_orderkey as d, l_linenumber as n, min(l_partkey) % 3 as p, sum(l_quantity)::bigint % 2 as q from lineitem where l_orderkey in (select o_orderkey from orders) group by 1, 2), y as (select *, row_number() over (partition by d order by n) as rn from l where p = 0), o as (select *, row_number() over (partition by d order by n) as rn from l where p = 1 and q = 0)
select d as doc_id, n as "row", 0 as "column", '[v] yes' as text from y where rn = 1 union all select d, n, 1, '(희망 자격 : F-2$1)' from y where rn = 1 and q = 0 and d % 2 = 1 union all select d, n, 1, '(희망 자격 : E-9)' from o where rn = 1""",
}
