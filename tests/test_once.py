"""Work that is done once for each row, and what does not travel."""

import random
import re

from pyspark.sql import functions as F

from caseflow.functions.facts import MACHINE_STEPS, machine_tokens
from caseflow.operators import language, records, regions
from caseflow.operators.discovery import field_union
from caseflow.plans import discovery, edits, reviews
from caseflow.plans import language as language_plans
from caseflow.sources import phrases

SF_DIR = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_record_texts_are_read_and_split_once(spark):
    plan = plan_of(edits.kv_records(spark, SF_DIR))
    assert plan.count("Relation [") == 1 and plan.count("split(") == 1
    texts = {1: "a=1\n b = x = y \n\n# c d= ", 2: "a\n=b", 3: "=b", 4: "a=1\na=2", 5: "# c", 6: "a=\x00", 7: None, 8: "﻿k=  long  "}
    rows = phrases.parse_kv_rows(spark.createDataFrame(list(texts.items()), "record_id long, text string"))
    found = {(r["record_id"], r["key"], r["value"], r["error"]) for r in rows.collect()}
    wrong = {2: "NO_EQUALS_SIGN", 3: "EMPTY_KEY", 4: "DUPLICATE_KEY", 5: "NO_VALUES", 6: "NUL_BYTE", 7: "NO_VALUES"}
    assert found == {(1, "a", "1", None), (1, "b", "x = y", None), (1, "d", "", None), (8, "k", "long", None)} | {(k, None, None, e) for k, e in wrong.items()}


def test_numbers_are_looked_for_near_digits_and_found_as_in_the_whole_text(spark):
    def plain(text):
        found = []
        for kind, pattern in MACHINE_STEPS:
            if kind:
                drop = {"money": " ", "number": ","}.get(kind, "\0")
                found += [m.group(0).replace(drop, "") for m in re.finditer(pattern.replace(r"\p{L}\p{N}_", r"\w"), text)]
            text = re.sub(pattern.replace(r"\p{L}\p{N}_", r"\w"), "", text)
        return found

    rng = random.Random(5)
    parts = [*"0123456789 \n.,-/년월일원$USDxyz가", " USD", "2026-03-", "010-1234-5678", "http://a ", "a@b.cd ", "some words. "]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", machine_tokens(F.col("t")).alias("k"))
    assert {r["i"]: r["k"] for r in rows.collect()} == {i: plain(t) for i, t in enumerate(texts)}
    assert "\\D*" in plan_of(rows)


def test_no_text_is_shuffled_to_its_tokens(spark):
    lines = plan_of(language_plans.validate_candidates(spark, SF_DIR)).splitlines()
    side = lines[next(i for i, x in enumerate(lines) if "Join" in x) + 1]  # the side of the join that the checks come from
    assert " AS r#" in side and " AS d#" in side
    none = "array<string>"
    pairs = spark.createDataFrame([(1, " \n", ["a"], "", None, None, ["b", "c"], "7")], f"id long, request_reason string, requested_items {none}, submission_method string, deadline date, cand_reason string, cand_items {none}, cand_method string")
    assert language.validate_candidate(pairs).first()["failed_checks"] == ["request_reason.present", "requested_items.cardinality", "facts.no_addition"]


def exchanges(spark, make):
    """Shuffles of a query's plan where no table is broadcast."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        return make()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    finally:
        spark.conf.set(name, before)


def test_cells_are_shuffled_once_to_their_labels(spark):
    # lines to their places twice, documents twice, cells once
    assert exchanges(spark, lambda: edits.fill_by_label(spark, SF_DIR)) <= 5
    # lines, options and cells once
    assert exchanges(spark, lambda: reviews.application_options(spark, SF_DIR)) <= 3


def test_labels_of_one_document_find_cells_by_either_script(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, "성명 Name"), (1, 0, 0, 2, "x"), (1, 0, 1, 0, ""), (1, 0, 3, 0, "Name"), (2, 0, 0, 0, "Name"), (2, 0, 0, 1, None)], "doc_id long, table_id int, row int, column int, text string")
    values = spark.createDataFrame([(1, "a", "성 명", "u"), (1, "a", "name!", "u"), (1, "b", "NAME", "v"), (1, "c", None, "w"), (2, "a", "12", "u")], "doc_id long, key string, label string, value string")
    found = records.fill_by_label(cells, values, below=["b"])
    assert sorted(map(tuple, found.collect())) == [(1, 0, 0, 2, "a", "u"), (1, 0, 1, 0, "b", "v")]


def test_all_passes_over_cells_share_one_shuffle(spark):
    # lines to their places, cells to their documents, the count of fields
    assert exchanges(spark, lambda: discovery.field_union(spark, SF_DIR)) <= 3
    texts = ["성명", "", " ", "", "", "yyyy", "mm", "dd", "원", "", "□ a", "[ ] x", None]
    rows = [(1, 0, 0, 2 * i if i > 9 else i, t) for i, t in enumerate(texts)] + [(1, 0, 1, 0, "공용란"), (1, 0, 2, 0, "성명"), (1, 0, 2, 1, "")]
    cells = spark.createDataFrame(rows, "doc_id long, table_id int, row int, column int, text string")
    found = {(r["row"], r["column"], r["kind"], r["label"]) for r in field_union(cells).collect()}
    assert found == {(0, 1, "character_grid", "성명"), (0, 5, "date_segments", "성명"), (0, 8, "amount_unit", "dd"), (0, 9, "blank", "원"), (0, 22, "checkbox", "x")}


def test_verdicts_meet_their_views_in_one_shuffle(spark):
    assert exchanges(spark, lambda: edits.check_evidence(spark, SF_DIR)) <= 3  # lines twice, then verdicts and views together
    views = spark.createDataFrame([(1, 1, "f1", "full"), (1, 1, "d1", "detail"), (1, 2, "f2", "full"), (1, 3, "n", None), (1, None, "x", "full"), (None, 1, "f1", "full")], "doc_id long, field_id long, view_id string, kind string")
    verdicts = spark.createDataFrame(
        [(1, 1, ["f1"]), (1, 2, ["f2", None]), (1, 3, ["n"]), (1, 4, ["x"]), (1, 5, ["f1", "zz"]), (1, 6, None), (1, None, ["x"]), (None, 1, ["f1"]), (2, 1, ["f1"])], "doc_id long, field_id long, view_ids array<string>"
    )
    found = {(r["doc_id"], r["field_id"]): r["error"] for r in regions.check_evidence(verdicts.unionByName(verdicts.where("field_id = 2")), views).collect()}
    other, unknown = "VIEW_OF_OTHER_FIELD", "UNKNOWN_VIEW"
    assert found == {(1, 1): "DETAIL_REQUIRED", (1, 2): None, (1, 3): other, (1, 4): other, (1, 5): unknown, (1, 6): "EVIDENCE_MISSING", (1, None): other, (None, 1): unknown, (2, 1): unknown}


def test_a_label_meets_the_next_row_beside_it(spark):
    rows = [(1, 0, 0, 1, "성명 a"), (1, 0, 0, 3, "성명"), (1, 0, 4, 0, ""), (1, 0, 4, 1, " "), (1, 0, 4, 2, "x"), (1, 0, 7, 0, "성명"), (1, 1, 8, 0, ""), (None, 0, 0, 0, "성명"), (None, 0, 1, 0, "")]
    cells = spark.createDataFrame(rows, "doc_id long, table_id int, row int, column int, text string")
    found = regions.spatial_below(cells)
    assert "Join" not in plan_of(found)
    assert [tuple(r) for r in found.select("doc_id", "table_id", "label_row", "label_column", "label", "row", "column").collect()] == [(1, 0, 0, 1, "성명 a", 4, 0)]
