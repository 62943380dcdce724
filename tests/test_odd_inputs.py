"""Odd tables: registered queries against their SQL twins, operators against what they must give."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from caseflow.operators import language
from caseflow.plans import slots

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("big", [False, True], ids=["odd", "big"])
def test_files_are_admitted_as_the_sql_says(spark, tmp_path, big):
    """Empty and missing texts, sources that are no file names, keys below zero and none; texts whose size leaves 32 bits."""
    odd = [(3, ""), (4, None), (10, "a" * 2200), (13, "x"), (16, "x"), (7, None), (25, ""), (-1, "x"), (-2, "x"), (-5, "x"), (-7, "x"), (None, "x"), (None, "a" * 2200)]
    rows = [(i, "b" * 214_749) for i in range(8)] if big else odd
    sources = ["s", "", None, "a/b", "..", "a\\b"]
    spark.createDataFrame([(i, t, "en", sources[n % 6], len(t or "")) for n, (i, t) in enumerate(rows)], DOCUMENTS).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert Counter(map(tuple, slots.file_admission(spark, str(tmp_path)).collect())) == Counter(con.execute(slots.ORACLE_SQL["file_admission"]).fetchall())


REQUESTS = "request_id int, request_reason string, requested_items array<string>, deadline string, submission_method string"


def test_queries_hold_clean_texts_and_the_tokens_of_every_part(spark):
    rows = [
        (1, "  re\u0301sume\u0301 1,000.5 ", [" a 2024.1.2", None, "e\u0301 "], " 2026.2.3 ", " by 5KG "),
        (2, "pay 1,000", None, "2026-02-03", "m 1.000,5 2,000"),
        (3, None, ["x"], None, "m"),
    ]
    got = {(r["request_id"], r["query_kind"]): (r["text"], r["error"]) for r in language.build_queries(spark.createDataFrame(rows, REQUESTS)).collect()}
    assert got[1, "canonical"] == ("요청 목적 résumé 1,000.5; 자료 a 2024.1.2, é; 기한 2026.2.3; 방법 by 5KG; 정규 보호값 1000.5, 2024-01-02, 2026-02-03, 5kg", None)
    assert got[1, "action_deadline"][0].startswith("기한 2026.2.3; 방법 by 5KG; 요청 목적 résumé 1,000.5; 자료 a 2024.1.2, é; 정규")
    assert got[2, "reason_items"] == ("요청 목적 pay 1,000; 방법 m 1.000,5 2,000; 기한 2026-02-03; 정규 보호값 1000, 2000", None)
    assert got[3, "reason_items"] == ("자료 x; 방법 m", None) and len(got) == 9


def test_a_query_that_lacks_a_token_is_an_error(spark, monkeypatch):
    token = F.struct(*[F.lit("12").alias(c) for c in ("kind", "surface", "canonical")])
    monkeypatch.setattr(language, "extract_facts", lambda text, clean=False: F.array(token))
    rows = spark.createDataFrame([(1, "no token", ["x"], "2026-02-03", "m"), (2, "12", ["x"], "2026-02-03", "m")], REQUESTS)
    assert {(r["request_id"], r["error"]) for r in language.build_queries(rows).collect()} == {(1, "QUERY_TOKEN_OMITTED"), (2, None)}
