import hashlib
import json
import uuid

from pyspark.sql import functions as F

from caseflow.functions import text as fx
from caseflow.operators import cases, corpus, forms, retrieval


def test_content_address_equals_json_and_uuid5(spark):
    texts = ["가나 \"x\"\t/", "plain", "é'"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(fx.content_hash(F.lit("01"), F.col("t"), F.lit("b")).alias("h")).withColumn("p", fx.point_id(F.col("h"))).collect()
    for t, row in zip(texts, got, strict=True):
        want = hashlib.sha256(json.dumps(["01", t, "b"], ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()
        assert row["h"] == want and row["p"] == str(uuid.uuid5(fx.POINT_NAMESPACE, want))


def test_clean_phrases_rejects_in_order_and_keeps_the_smallest_page(spark):
    raw = spark.createDataFrame(
        [("01", "3", " a ", "b"), ("01", "2", "a", "b"), ("99", "0", "a", "b"), ("01", "0", "", "b"), ("01", "x", "a", "b"), ("01", "1", "　", "b"), ("01", "1", "a", None)],
        "lang_code string, page string, korean string, foreign_translation string",
    )
    summary = {r["reason"]: r["n"] for r in corpus.clean_summary(corpus.clean_phrases(raw, "r")).collect()}
    assert summary == {"usable": 1, "duplicate": 1, "invalid_language": 1, "invalid_page": 2, "blank_source": 1, "blank_translation": 1}
    assert corpus.clean_phrases(raw, "r").where("reject_reason is null").first()["page"] == 2


def test_rrf_counts_a_point_once_per_kind(spark):
    rows = spark.createDataFrame([(1, "a", 7, 0), (1, "a", 7, 3), (1, "b", 7, 1), (1, "b", 8, 0)], "request_id int, query_kind string, point_id int, rank int")
    got = {r["point_id"]: r for r in retrieval.rrf_fuse(rows).collect()}
    assert abs(got[7]["score"] - (1 / 60 + 1 / 61)) < 1e-12 and got[7]["query_kinds"] == "a,b" and got[7]["rank"] == 0
    assert retrieval.rrf_fuse(rows.limit(0)).count() == 0


def test_dense_topk_cuts_groups_before_the_shuffle(spark):
    scored = spark.range(100).select((F.col("id") % 5).alias("request_id"), F.col("id").alias("point_id"), F.rand(1).alias("score"))
    plan = retrieval.rank_candidates(scored, keys=["request_id"], limit=3)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


def test_transitions_and_plans(spark):
    history = spark.createDataFrame([(1, 1, "DRAFT"), (1, 2, "APPROVED"), (1, 3, "IN_PROGRESS"), (1, 4, "COMPLETED"), (1, 5, "DRAFT")], "case_id int, seq int, status string")
    assert [r["allowed"] for r in cases.check_transitions(history).orderBy("seq").collect()] == [True, False, True, True, False]
    attempts = spark.createDataFrame([(1, i, i, r) for i, r in enumerate(["OK", "ABORTED_NO_OUTPUT", "OK", "OK"])], "doc_id int, attempt_id int, started_at int, result string")
    assert [r["needs_human"] for r in forms.attempt_sequence(attempts).orderBy("sequence").collect()] == [False, False, False, True]


def test_resume_merges_slots(spark):
    old = spark.createDataFrame([(1, {"a": "1", "b": "2"}, "go")], "task_id int, slots map<string,string>, instruction string")
    new = spark.createDataFrame([(1, {"b": "3"}, "")], "task_id int, slots map<string,string>, instruction string")
    row = cases.merge_resume(old, new).first()
    assert row["slots"] == {"a": "1", "b": "3"} and row["instruction"] == "go"
