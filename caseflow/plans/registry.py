"""Registered queries of the library's operators over the given tables, and their SQL twins.

Every query derives its input from whole tables by Spark: phrases and cells from documents, rankings and histories from events, plans
from orders, so that its work grows with them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import text as fx
from caseflow.operators import cases, corpus, forms, retrieval
from caseflow.sources.shared import text_batches


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw phrases: all lines of a document in pairs, source and translation."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.split("text", "\n")
    pair = lambda i: F.struct(F.element_at("lines", i).alias("korean"), F.coalesce(F.try_element_at("lines", i + 1), F.lit("")).alias("foreign_translation"))
    code = F.when(F.col("lang") == "en", "01").when(F.col("lang") == "de", "02").when(F.col("lang") == "es", "03").otherwise("99")
    rows = docs.select(code.alias("lang_code"), (F.col("doc_id") % 40).cast("string").alias("page"), lines.alias("lines"))
    return rows.select("lang_code", "page", F.explode(F.transform(F.sequence(F.lit(1), F.size("lines"), F.lit(2)), pair)).alias("p")).select("lang_code", "page", "p.*")


_RAW_SQL = r"""split as (select lang, doc_id, string_split(text, chr(10)) as l from documents), pairs as (select lang, doc_id, l, unnest(range(1, len(l) + 1, 2)) as i from split),
raw as (select case lang when 'en' then '01' when 'de' then '02' when 'es' then '03' else '99' end as lang_code, (doc_id % 40) as page,
  regexp_replace(regexp_replace(l[i], '^[\s\x{0B}\x{85}\p{Z}]+', ''), '[\s\x{0B}\x{85}\p{Z}]+$', '') as korean_text,
  regexp_replace(regexp_replace(coalesce(l[i + 1], ''), '^[\s\x{0B}\x{85}\p{Z}]+', ''), '[\s\x{0B}\x{85}\p{Z}]+$', '') as translated_text from pairs),
marked as (select *, case when lang_code = '99' then 'invalid_language' when page <= 0 then 'invalid_page' when korean_text = '' then 'blank_source' when translated_text = '' then 'blank_translation' end as reject_reason from raw)"""


def clean_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = corpus.clean_phrases(_phrases(spark, sf_dir), "sha256:test").where("reject_reason is null")
    return cleaned.select("lang_code", "korean_text", "translated_text", "content_hash", F.col("page").cast("long").alias("page"), F.col("duplicates").cast("long").alias("duplicates"))


def clean_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = corpus.clean_summary(corpus.clean_phrases(_phrases(spark, sf_dir), "sha256:test"))
    return found.where("n > 0").select("reason", F.col("n").cast("long").alias("n"))


def _rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    scored = events.groupBy(F.col("user_id").alias("request_id"), F.col("event_type").alias("query_kind"), (F.col("event_id") % 97).alias("point_id")).agg(F.max("value").alias("score"))
    return retrieval.rank_candidates(scored, keys=["request_id", "query_kind"], limit=40)


_RANK_SQL = """ranked as (select *, row_number() over (partition by request_id, query_kind order by score desc, point_id) - 1 as rank from
  (select user_id as request_id, event_type as query_kind, event_id % 97 as point_id, max(value) as score from events group by all) qualify rank < 40)"""
FUSED_SQL = (
    _RANK_SQL
    + """, fused as (select request_id, point_id, min(rank) as best_rank, list_sum(list(1.0::double / (60.0 + rank) order by query_kind)) as score, string_agg(query_kind, ',' order by query_kind) as query_kinds
  from ranked group by all), top as (select *, row_number() over (partition by request_id order by score desc, best_rank, point_id) - 1 as rank from fused qualify rank < 30)"""
)


def rank_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rankings(spark, sf_dir).select("request_id", "query_kind", "point_id", "score", F.col("rank").cast("long").alias("rank"))


def rrf_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = retrieval.rrf_fuse(_rankings(spark, sf_dir))
    return fused.select("request_id", "point_id", F.col("best_rank").cast("long").alias("best_rank"), F.round("score", 9).alias("score"), "query_kinds")


def _cases(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Retrieved lists from fused rankings; a user's relevant points are those of its purchases and clicks by size."""
    retrieved = retrieval.rrf_fuse(_rankings(spark, sf_dir)).select(F.col("request_id").alias("case_id"), "point_id", (F.col("rank") + 1).alias("pos"))
    graded = _table(spark, sf_dir, "events").where("value > 0").groupBy(F.col("user_id").alias("case_id"), (F.col("event_id") % 97).alias("point_id"))
    return retrieved, graded.agg(F.least(F.count("*"), F.lit(3)).cast("int").alias("grade"))


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieval_metrics(*_cases(spark, sf_dir))


def retrieval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.retrieval_report(retrieval_metrics(spark, sf_dir))


_METRICS_SQL = (
    FUSED_SQL
    + """, rel as (select user_id as case_id, event_id % 97 as point_id, least(count(*), 3) as grade from events where value > 0 group by all),
got as (select request_id as case_id, top.point_id, rank + 1 as pos, coalesce(grade, 0) as grade from top left join rel on rel.case_id = request_id and rel.point_id = top.point_id),
seen as (select case_id, sum((grade > 0 and pos <= 5)::int) h5, sum((grade > 0 and pos <= 10)::int) h10, sum((grade > 0 and pos <= 30)::int) h30, max(case when grade > 0 and pos <= 10 then 1.0::double / pos end) as mrr,
  sum(case when pos <= 10 then round((2.0::double ** grade - 1) / log2(pos + 1.0::double) * 1e9)::bigint else 0 end) as dcg, least(count(*), 5) as shown from got group by 1),
best as (select case_id, count(*) as n, sum(case when p <= 10 then round((2.0::double ** grade - 1) / log2(p + 1.0::double) * 1e9)::bigint else 0 end) as ideal from
  (select *, row_number() over (partition by case_id order by grade desc, point_id) as p from rel) group by 1),
cases as (select coalesce(seen.case_id, best.case_id) as case_id, coalesce(case when n > 0 then coalesce(h5, 0) / n end, 0.0)::double as recall_5, coalesce(case when n > 0 then coalesce(h10, 0) / n end, 0.0)::double as recall_10,
  coalesce(case when n > 0 then coalesce(h30, 0) / n end, 0.0)::double as recall_30, coalesce(mrr, 0.0) as mrr_10, coalesce(case when ideal > 0 then coalesce(dcg, 0) / ideal end, 0.0)::double as ndcg_10,
  coalesce(case when shown > 0 then h5 / shown end, 0.0)::double as precision_5 from seen full outer join best on seen.case_id = best.case_id)"""
)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    queries = vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("dense"))
    found = retrieval.dense_topk(vectors.select(F.col("vec_id").alias("point_id"), F.col("embedding").alias("dense")), queries)
    return found.select("request_id", "point_id", F.col("rank").cast("long").alias("rank"))


def sparse_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = _table(spark, sf_dir, "conversations")
    words = talk.select((F.col("conv_id") * 1000 + F.col("turn")).alias("point_id"), F.explode(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) > 4)).alias("idx"))
    postings = words.groupBy("point_id", "idx").agg(F.count("*").alias("w"))
    queries = postings.where("point_id % 1000 = 0").withColumnRenamed("point_id", "request_id")
    return retrieval.sparse_topk(postings, queries).select("request_id", "point_id", F.col("score").cast("long").alias("score"), F.col("rank").cast("long").alias("rank"))


def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.latency_percentiles(_table(spark, sf_dir, "events"), branch="event_type", latency="value")
    return found.select("event_type", F.round("p50", 6).alias("p50"), F.round("p95", 6).alias("p95"))


def resolve_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 3 == 0, F.element_at(F.array(*map(F.lit, ["en", " vi ", "vn", "tl", "xx", "VI"])), (F.col("c_custkey") % 6 + 1).cast("int"))).alias("preferred_language"),
        F.element_at(F.array(*map(F.lit, ["cn", "VN", "TL", "zz", " kh"])), (F.col("c_custkey") % 5 + 1).cast("int")).alias("nationality_code"),
    )
    return cases.resolve_language(rows).select("c_custkey", "target_language", "language_source", "language_warning", "language_error")


def check_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["DRAFT", "NEEDS_INFO", "READY_FOR_REVIEW", "APPROVED", "IN_PROGRESS", "COMPLETED"]
    status = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    history = _table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), F.col("event_id").alias("seq"), status.alias("status"))
    return cases.check_transitions(history).groupBy("previous", "status", "allowed").agg(F.count("*").alias("n"))


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.latest_snapshot(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), key="user_id", version="event_id")


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form cells: an order's lines as rows; blank or labelled by their values."""
    lines = _table(spark, sf_dir, "lineitem")
    text = [F.col("l_returnflag"), *[F.when(F.col("l_quantity") % k == 0, F.lit(f"q{k}")).otherwise("") for k in (2, 3, 5, 7, 11, 13)]]
    cell = F.posexplode(F.array(*text)).alias("column", "text")
    return lines.select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("table_id"), F.col("l_linenumber").alias("row"), cell)


_CELLS_SQL = """cells as (select l_orderkey as doc_id, l_partkey * 1000 + l_suppkey as table_id, l_linenumber as "row", unnest(range(7)) as "column", unnest([l_returnflag, case when l_quantity % 2 = 0 then 'q2' else '' end, case when l_quantity % 3 = 0 then 'q3' else '' end,
  case when l_quantity % 5 = 0 then 'q5' else '' end, case when l_quantity % 7 = 0 then 'q7' else '' end, case when l_quantity % 11 = 0 then 'q11' else '' end, case when l_quantity % 13 = 0 then 'q13' else '' end]) as text from lineitem)"""


def label_blank_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.label_blank_pairs(_cells(spark, sf_dir)).select("doc_id", "row", "label", F.col("column").cast("long").alias("column"))


def character_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.character_grids(_cells(spark, sf_dir)).select("doc_id", "row", F.col("column").cast("long").alias("column"), "label", "slots")


def diff_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_partkey").alias("item_id"), F.col("l_linenumber").alias("ln"), "l_returnflag", "l_linestatus")
    items = items.groupBy("doc_id", "item_id").agg(F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"), F.max("ln").alias("ln"))
    before = items.where("ln % 3 != 0").select("doc_id", "item_id", F.col("f").alias("text"))
    after = items.where("ln % 4 != 0").select("doc_id", "item_id", F.when(F.col("ln") == 5, F.col("s")).otherwise(F.col("f")).alias("text"))
    return forms.diff_cells(before, after)


def current_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("plan_id"), F.col("o_orderdate").alias("created_at"))
    return forms.current_plan(plans).select("doc_id", "plan_id", F.col("superseded_at").cast("string").alias("superseded_at"), "is_current")


def attempt_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("attempt_id"), F.col("o_orderdate").alias("started_at"), F.when(F.col("o_orderstatus") == "F", "ABORTED_NO_OUTPUT").otherwise("OK").alias("result")
    )
    return forms.attempt_sequence(rows).select("attempt_id", F.col("sequence").cast("long").alias("sequence"), F.col("counted").cast("long").alias("counted"), "needs_human")


def best_ocr_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_type").alias("name"), F.col("props").alias("text"), F.round("value", 1).alias("confidence"), F.col("event_id").alias("pos"))
    return forms.best_ocr_field(rows)


def rollup_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = F.when(F.col("l_quantity") > 49, "FAIL").when(F.col("l_quantity") > 40, "NEEDS_HUMAN").otherwise("PASS")
    return forms.rollup_verdict(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), verdict.alias("verdict")))


def snapshot_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return corpus.snapshot_conflicts(docs.select(F.concat_ws("/", "lang", "source").alias("name"), F.sha2("text", 256).alias("fingerprint")))


def language_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.language_coverage(_table(spark, sf_dir, "documents").select(F.col("lang").alias("target_language"), F.col("source").alias("scenario_type")))


def max_page_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The largest page number of the links in a page and its address."""
    pages = _table(spark, sf_dir, "pages")
    return pages.select("page_id", fx.max_page_number(F.concat("url", F.lit(" "), "html"), pattern=r"[?&]page=(\d{1,9})").cast("long").alias("pages"))


QUERIES = {
    f.__name__: f
    for f in (
        clean_phrases, clean_summary, rank_candidates, rrf_fuse, retrieval_metrics, retrieval_report, dense_topk, sparse_topk, latency_percentiles, resolve_language, check_transitions,
        latest_snapshot, label_blank_pairs, character_grids, diff_cells, current_plan, attempt_sequence, best_ocr_field, rollup_verdict, snapshot_conflicts, language_coverage, max_page_number,
    )
}
FLAGSHIP = retrieval_report

_NEXT = "('DRAFT','NEEDS_INFO'),('DRAFT','READY_FOR_REVIEW'),('NEEDS_INFO','DRAFT'),('NEEDS_INFO','READY_FOR_REVIEW'),('NEEDS_INFO','IN_PROGRESS'),('READY_FOR_REVIEW','APPROVED'),('READY_FOR_REVIEW','NEEDS_INFO'),('APPROVED','IN_PROGRESS'),('IN_PROGRESS','NEEDS_INFO'),('IN_PROGRESS','COMPLETED')"
ORACLE_SQL = {
    "clean_phrases": f"with {_RAW_SQL} select lang_code, korean_text, translated_text, sha256(to_json([lang_code, korean_text, translated_text])::varchar) as content_hash, min(page) as page, count(*) - 1 as duplicates from marked where reject_reason is null group by 1, 2, 3",
    "clean_summary": f"with {_RAW_SQL}, good as (select count(*) - 1 as d from marked where reject_reason is null group by lang_code, korean_text, translated_text), s as (select reject_reason as reason, count(*) as n from marked where reject_reason is not null group by 1 union all select 'usable', count(*) from good union all select 'duplicate', sum(d)::bigint from good) select * from s where n > 0",
    "rank_candidates": f"with {_RANK_SQL} select request_id, query_kind, point_id, score, rank from ranked",
    "rrf_fuse": f"with {FUSED_SQL} select request_id, point_id, best_rank, round(score, 9) as score, query_kinds from top",
    "retrieval_metrics": f"with {_METRICS_SQL} select * from cases",
    "retrieval_report": f"with {_METRICS_SQL} select count(*) as n_cases, round(avg(recall_5), 6) as recall_5, round(avg(recall_10), 6) as recall_10, round(avg(recall_30), 6) as recall_30, round(avg(mrr_10), 6) as mrr_10, round(avg(ndcg_10), 6) as ndcg_10, round(avg(precision_5), 6) as precision_5 from cases",
    "dense_topk": "select q.vec_id as request_id, p.vec_id as point_id, row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.embedding::double[], p.embedding::double[]), 12) desc, p.vec_id) - 1 as rank from embeddings q, embeddings p where q.vec_id % 20 = 0 qualify rank < 40",
    "sparse_topk": "with p as (select conv_id * 1000 + turn as point_id, w as idx, count(*) as w from (select conv_id, turn, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as w from conversations) where length(w) > 4 group by all), s as (select q.point_id as request_id, p.point_id, sum(q.w * p.w)::bigint as score from p q join p on q.idx = p.idx where q.point_id % 1000 = 0 group by all) select *, row_number() over (partition by request_id order by score desc, point_id) - 1 as rank from s qualify rank < 40",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 6) as p50, round(quantile_cont(value, 0.95), 6) as p95 from events group by 1",
    "resolve_language": """with l(c, n, a) as (values ('en', null, null), ('zh-Hans', 'CN', null), ('vi', 'VN', 'vn'), ('th', 'TH', null), ('fil', 'PH', 'ph'), ('id', 'ID', null), ('mn', 'MN', null), ('si', 'LK', 'lk'), ('ru', 'RU', null), ('uz', 'UZ', null), ('ky', 'KG', 'kg'), ('bn', 'BD', 'bd'), ('ur', 'PK', 'pk'), ('km', 'KH', 'kh'), ('tet', 'TL', 'tl')),
      r as (select c_custkey, case when c_custkey % 3 = 0 then trim(['en', ' vi ', 'vn', 'tl', 'xx', 'VI'][c_custkey % 6 + 1]) end as p, upper(trim(['cn', 'VN', 'TL', 'zz', ' kh'][c_custkey % 5 + 1])) as nat from customer),
      j as (select r.*, c1.c as canon, c2.c as alias, c3.c as nation from r left join l c1 on c1.c = p left join l c2 on c2.a = p left join l c3 on c3.n = nat),
      s as (select *, case when canon is not null then 'preferred' when alias is not null then 'legacy_preferred' when p is not null then null when nation is not null then 'nationality' else 'default' end as src from j)
      select c_custkey, case when p is not null then coalesce(canon, alias) else coalesce(nation, 'en') end as target_language, src as language_source, case src when 'legacy_preferred' then 'LANGUAGE_CODE_NORMALIZED' when 'nationality' then 'LANGUAGE_INFERRED_FROM_NATIONALITY' when 'default' then 'LANGUAGE_DEFAULTED_TO_ENGLISH' end as language_warning, case when src is null then 'UNSUPPORTED_PREFERRED_LANGUAGE' end as language_error from s""",
    "check_transitions": f"with h as (select ['DRAFT','NEEDS_INFO','READY_FOR_REVIEW','APPROVED','IN_PROGRESS','COMPLETED'][event_id % 6 + 1] as status, user_id, event_id from events), p as (select lag(status) over (partition by user_id order by event_id) as previous, status from h) select previous, status, (previous is null or (previous, status) in ({_NEXT})) as allowed, count(*) as n from p group by all",
    "latest_snapshot": "select user_id, event_id, event_type, value from events qualify row_number() over (partition by user_id order by event_id desc) = 1",
    "label_blank_pairs": f'with {_CELLS_SQL}, n as (select *, lead(text) over w as nt, lead("column") over w as nc from cells window w as (partition by doc_id, table_id, "row" order by "column")) select doc_id, "row", text as label, nc as "column" from n where text != \'\' and nt = \'\'',
    "character_grids": f"""with {_CELLS_SQL}, m as (select *, row_number() over w - sum((text = '')::int) over w as island, last_value(case when text != '' then text end ignore nulls) over w as label from cells window w as (partition by doc_id, table_id, "row" order by "column"))
      select doc_id, "row", min("column") as "column", any_value(label) as label, count(*) as slots from m where text = '' group by doc_id, table_id, "row", island having count(*) >= 4 and any_value(label) is not null""",
    "diff_cells": "with i as (select l_orderkey as doc_id, l_partkey as item_id, max(l_returnflag) as f, max(l_linestatus) as s, max(l_linenumber) as ln from lineitem group by 1, 2), b as (select *, f as t from i where ln % 3 != 0), a as (select *, case when ln = 5 then s else f end as t from i where ln % 4 != 0) select coalesce(b.doc_id, a.doc_id) as doc_id, coalesce(b.item_id, a.item_id) as item_id, case when b.doc_id is null then 'added' when a.doc_id is null then 'removed' else 'changed' end as change, coalesce(b.t, '') as old, coalesce(a.t, '') as new from b full outer join a on a.doc_id = b.doc_id and a.item_id = b.item_id where a.doc_id is null or b.doc_id is null or a.t != b.t",
    "current_plan": "select o_custkey as doc_id, o_orderkey as plan_id, lead(o_orderdate) over w::varchar as superseded_at, lead(o_orderkey) over w is null as is_current from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "attempt_sequence": "select o_orderkey as attempt_id, row_number() over w as sequence, (sum((o_orderstatus != 'F')::int) over w)::bigint as counted, sum((o_orderstatus != 'F')::int) over w > 2 as needs_human from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)",
    "best_ocr_field": "select user_id as doc_id, event_type as name, props as text, round(value, 1) as confidence from events qualify row_number() over (partition by user_id, event_type order by round(value, 1) desc, event_id desc) = 1",
    "rollup_verdict": "select l_orderkey as doc_id, case when max(l_quantity) > 49 then 'FAIL' when max(l_quantity) > 40 then 'NEEDS_HUMAN' else 'PASS' end as verdict from lineitem group by 1",
    "snapshot_conflicts": "select lang || '/' || source as name, count(distinct text) as n_fingerprints from documents group by 1 having count(distinct text) > 1",
    "language_coverage": "select lang as target_language, count(*) as n_cases, count(distinct source) as n_scenarios from documents group by 1",
    "max_page_number": r"select page_id, coalesce(list_max(list_transform(regexp_extract_all(url || ' ' || html, '[?&]page=(\d{1,9})', 1), lambda x: x::bigint)), 1) as pages from pages",
}
