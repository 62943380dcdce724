"""Operators that SQL can't express, and corners of others, against plain Python."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from caseflow.functions import facts, fields
from caseflow.operators import language, ocr, regions, retrieval, slots, terms
from caseflow.sources import phrases

TEXTS = [
    None, "", "Pay 1,200.50 by 2024-02-30 or 2024.3.4, see https://a.b/c?d=1. Mail x.y@z.co; +82 10-1234-5678", "Bring 3kg and 12개 at 9시 30분, 10:15:00, v1.2.3 AB-12-c.5 -7 USD 500만원", "2024년 3월 5일까지 5,000원 1.5L 20%",
    "no facts é한국 a1 1a", "10-20-30-40 x 2024-1-5T1 5 kg",
]


def _facts(text):
    """The rules as a plain loop over Python's own regular expressions."""
    found, taken = [], []
    for kind, pattern in facts.TOKEN_PATTERNS.items():
        for m in re.finditer(pattern, (text or "").strip()):
            if any(m.start() < b and a < m.end() for a, b in taken):
                continue
            taken.append(m.span())
            surface = m[0].rstrip(".,;:!?") if kind == "url" else m[0]
            found.append((m.start(), m.end(), kind, surface))
            whole = re.match(r"[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)", surface) if kind == "unit" else None
            if whole and not surface[whole.end() :].startswith("."):
                found.append((m.start(), m.start() + whole.end(), "number", whole[0]))
    return sorted(found)


def test_facts_against_python(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", facts.extract_facts(F.col("t")).alias("f")).orderBy("i").collect()
    for row, text in zip(rows, TEXTS, strict=True):
        assert [(f["start"], f["stop"], f["kind"], f["surface"]) for f in row["f"]] == _facts(text), text
    canonical = {f["surface"]: f["canonical"] for row in rows for f in row["f"]}
    assert canonical["1,200.50"] == "1200.50" and canonical["2024-02-30"] == "2024-02-30" and canonical["2024.3.4"] == "2024-03-04" and canonical["2024년 3월 5일"] == "2024-03-05" and canonical["1.5L"] == "1.5l"


def test_queries_name_other_spellings(spark):
    rows = spark.createDataFrame([(1, "pay 1,000", ["a 2024.1.2"], "2024-02-03", "m")], "request_id int, request_reason string, requested_items array<string>, deadline string, submission_method string")
    got = {r["query_kind"]: r["text"] for r in language.build_queries(rows).collect()}
    assert got["canonical"] == "요청 목적 pay 1,000; 자료 a 2024.1.2; 기한 2024-02-03; 방법 m; 정규 보호값 1000, 2024-01-02" and set(got) == {"canonical", "reason_items", "action_deadline"}


RESPONSE = "document_type string, country_code string, images array<struct<inferResult:string,matchedTemplate:struct<id:int>,fields:array<struct<name:string,inferText:string,inferConfidence:double>>>>"


def test_reviews_of_recognised_documents(spark):
    full = [("passport_number", " M 123 ", 0.9), ("surname", "A", 0.9), ("given_names", "B  C", 0.9), ("date_of_birth", "1990.01.02", 0.9), ("passport_expiry_date", "2030-01-02", 0.9), ("odd", "x", 0.9)]
    ok = lambda template, f: [("SUCCESS", (template,), f)]
    cases = [
        (("passport_copy", "KOR", ok(43019, full)), "succeeded", [], {"passport_number": "M123", "surname": "A", "given_names": "B C", "date_of_birth": "1990-01-02", "passport_expiry_date": "2030-01-02"}),
        (("passport_copy", "KOR", []), "review_required", ["template_not_matched"], {}),
        (("passport_copy", "KOR", ok(43021, full)), "review_required", ["unexpected_template"], {}),
        (("passport_copy", "KOR", ok(43019, full) * 2), "review_required", ["multiple_images"], None),
        (("passport_copy", "KOR", ok(43019, [*full[:3], ("date_of_birth", "bad", 0.99), ("date_of_birth", "1990-01-02", 0.5), full[4]])), "review_required", ["invalid_date:date_of_birth", "low_confidence:date_of_birth"], None),
        (("passport_copy", "KOR", ok(43019, full[1:])), "review_required", ["missing_required:passport_number"], None),
        (("arc", None, ok(43025, [("sex", "M", 0.9)])), "review_required", ["missing_required:arc_back_field"], {"sex": "M"}),
        (("arc", None, ok(43025, [("residence_address_1", "x", 0.5)])), "review_required", ["low_confidence:residence_address_1"], None),
        (("arc", None, ok(43024, [("alien_registration_number", "1 2", None)])), "review_required", ["low_confidence:alien_registration_number"], {"alien_registration_number": "12"}),
        (("passport_copy", "", ok(43038, [full[0], full[4], ("full_name", "NGUYEN VAN A", 0.9), ("mrz", "P<VNM 85 0101", 0.85)])), "succeeded", [], {"passport_number": "M123", "passport_expiry_date": "2030-01-02", "surname": "NGUYEN", "given_names": "VAN A", "date_of_birth": "1985-01-01"}),
    ]
    rows = spark.createDataFrame([c[0] for c in cases], RESPONSE).coalesce(1)
    for got, (_, status, reasons, values) in zip(ocr.ocr_review(rows, as_of="2026-01-01").collect(), cases, strict=True):
        assert (got["status"], got["review_reasons"]) == (status, reasons)
        assert values is None or got["fields"] == values
    assert ocr.ocr_review(rows.limit(0), as_of="2026-01-01").count() == 0


def test_dates_of_documents(spark):
    texts = ["2024-01-05", "2024.1.5", "05/01/2024", "5 JAN 2024", "5 01월 / JAN 2024", "5 02월 / JAN 2024", "2024-02-30", "x", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(fields.parse_document_date(F.col("t")).alias("a"), fields.parse_document_date(F.col("t"), day_first=True).alias("b")).collect()
    day = dt.date(2024, 1, 5)
    assert [r["a"] for r in rows] == [day, day, None, None, day, None, None, None, None] and [r["b"] for r in rows] == [day, day, day, day, day, None, None, None, None]


def test_records_of_pairs(spark, tmp_path):
    texts = {"ok": "﻿# c\n a = 1=2 \n\nb=\r\nc.d=x", "nul": "a=1\x00", "none": "# only\n", "twice": "a=1\n a=2", "bare": "a", "nokey": " =1"}
    for name, text in texts.items():
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    (tmp_path / "latin.txt").write_bytes(b"a=\xff\xfe")
    good, errors = phrases.read_kv_records(spark, str(tmp_path))
    name = lambda p: p.rsplit("/", 1)[1].split(".")[0]
    assert sorted((name(r[0]), r[1], r[2]) for r in good.collect()) == [("ok", "a", "1=2"), ("ok", "b", ""), ("ok", "c.d", "x")]
    assert {name(r[0]): r[1] for r in errors.collect()} == {"nul": "NUL_BYTE", "none": "NO_VALUES", "twice": "DUPLICATE_KEY", "bare": "NO_EQUALS_SIGN", "nokey": "EMPTY_KEY", "latin": "NOT_UTF8"}


def test_phrases_and_cases_from_files(spark, tmp_path):
    import json

    rows = [{"lang_code": "01", "page": 3, "korean": "가\n나", "foreign_translation": 'a "b"'}, {"lang_code": "99", "page": "x"}]
    (tmp_path / "p.json").write_text(json.dumps(rows, ensure_ascii=False))
    read = phrases.read_phrases(spark, str(tmp_path / "p.json"))
    assert [(r["lang_code"], r["page"]) for r in read.orderBy("lang_code").collect()] == [("01", "3"), ("99", "x")] and read.first()["dataset_revision"].startswith("sha256:")
    phrases.write_phrases(read, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out/csv"), header=True, multiLine=True, escape='"')
    assert back.columns == phrases.PHRASE_COLUMNS and back.where("lang_code = '01'").first()["foreign_translation"] == 'a "b"'
    try:
        phrases.read_phrases(spark, str(tmp_path / "p.json"), expected="sha256:0")
    except ValueError as error:
        assert "expected" in str(error)
    else:
        raise AssertionError("another revision must be refused")
    (tmp_path / "c.jsonl").write_text('{"case_id": "1"}\n{"case_id": ""}\n')
    assert [r["error"] for r in phrases.read_eval_cases(spark, str(tmp_path / "c.jsonl"), "case_id string").collect()] == [None, "CASE_ID_REQUIRED"]


def test_rows_of_stored_pages(spark):
    page = "<table><tr><td>z</td></tr></table><TABLE class=x><tr><th>h</th></tr><tr><td> 안<b>녕</b></td><td>hello <span>heh-lo</span></td></tr><tr><td>one</td></tr></table>"
    got = phrases.extract_html_rows(spark.createDataFrame([(1, page), (2, "<table></table>"), (3, None)], "page_id int, html string")).collect()
    assert [tuple(r)[2:] for r in got] == [("안녕", "hello", "heh-lo")]


def _bytes(root):
    return {p.relative_to(root): p.read_bytes() for p in sorted(root.rglob("*")) if p.is_file()}


def test_index_moves_only_when_verified(spark, tmp_path, monkeypatch):
    root, rows = str(tmp_path), lambda: {(r["point_id"], r["v"]) for r in phrases.read_index(spark, str(tmp_path)).collect()}
    assert phrases.read_index(spark, root) is None
    points = spark.createDataFrame([("a", "en", 1), ("b", "vi", 1)], "point_id string, target_language string, v int")
    publish = lambda df, ok: phrases.publish_index(df, root, dataset="d1", encoder="e", verified=ok)
    assert publish(points, lambda df: False) is None and phrases.read_index(spark, root) is None
    first = publish(points, lambda df: df.count() == 2)
    assert phrases.index_version(spark, root) == first
    before, again = _bytes(tmp_path), spark.createDataFrame([("a", "en", 2)], points.schema)
    # a refused run of the same names leaves every byte of what is in use
    assert publish(again, lambda df: False) is None
    after = _bytes(tmp_path)
    assert all(after[p] == data for p, data in before.items()) and rows() == {("a", 1), ("b", 1)}

    # a run that ends after the write and before the pointer
    def crash(df):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        publish(again, crash)
    assert phrases.index_version(spark, root) == first and rows() == {("a", 1), ("b", 1)}
    second = publish(again, lambda df: df.count() == 2)
    assert second != first and rows() == {("a", 2), ("b", 1)}
    publish(again, lambda df: df.count() == 2)
    assert rows() == {("a", 2), ("b", 1)}


def test_terms_need_no_comparison_of_all_with_all(spark):
    texts = spark.createDataFrame([(1, "abcdefgh ab"), (2, None), (3, ""), (4, "xabcdefg")], "text_id int, text string")
    words = spark.createDataFrame([(1, "abcdefgh"), (2, "ab"), (3, None), (4, ""), (5, "zz"), (6, "abcdefg")], "term_id int, term string")
    for few in (terms.BROADCAST_TERMS, 0):
        terms.BROADCAST_TERMS, before = few, terms.BROADCAST_TERMS
        found = terms.matched_terms(texts, words)
        assert {(r["text_id"], r["term_id"], r["at"]) for r in found.collect()} == {(1, 1, 1), (1, 2, 1), (1, 6, 1), (4, 2, 2), (4, 6, 2)}
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        terms.BROADCAST_TERMS = before


def test_percentiles_hold_no_branch_in_one_buffer(spark):
    rows = spark.createDataFrame([("a", 10.0), ("a", 20.0), ("a", 40.0), ("a", 100.0), ("b", None), ("c", 5.0), ("c", 5.0)], "b string, v double")
    got = {r["b"]: (round(r["p50"], 9), round(r["p95"], 9)) for r in retrieval.latency_percentiles(rows, branch="b", latency="v").collect()}
    assert got == {"a": (30.0, 91.0), "b": (0.0, 0.0), "c": (5.0, 5.0)}


def test_edits_and_empty_tables(spark):
    operations = spark.createDataFrame(
        [(1, i, *o) for i, o in enumerate([("write_character_grid", "1-2", None, None, ["-"], ["a", "b"]), ("set_date_segments", "2024-1-2", None, None, None, ["c", "a", "b"]), ("set_checkbox", "x", "[ ]", None, None, ["d"]), ("set_amount", "5", "원", "prefix_unit", None, ["e"]), ("other", "5", None, None, None, ["e", "e"])])],
        "doc_id int, field_id int, operation string, new_value string, anchor string, mode string, separators array<string>, cell_ids array<string>",
    )
    cells = spark.createDataFrame([(1, "a", "1"), (1, "b", "2"), (1, "c", "year 2024"), (1, "d", "[V] ok"), (1, "e", "5원")], "doc_id int, cell_id string, text string")
    assert {(r["field_id"], r["failure"]) for r in regions.check_typed_edits(operations, cells).collect()} == {(4, "value_once")}
    assert regions.check_typed_edits(operations.limit(0), cells).count() == 0
    done = fields.apply_cell_op(F.lit("replace"), F.lit("a?b?"), F.lit("v"), F.lit("?"), F.lit("<{value}>"))
    assert spark.range(1).select(done.alias("d")).first()["d"]["text"] == "a<v>b?"
    assert slots.identity_presence(spark.createDataFrame([(None, None, None)], "slots map<string,string>, ocr_fields map<string,string>, document_types array<string>")).first()["combo"] == "both_missing"


def test_catalogs_from_files(spark, tmp_path):
    from caseflow.operators import routing

    (tmp_path / "c.json").write_text('[{"workflow_id": "W", "intent": "I", "required_slots": ["b", "a"]}, {"intent": "x"}]')
    rows = routing.read_catalog(spark, str(tmp_path / "c.json"))
    assert [(r["workflow_id"], r["pos"], r["slot"]) for r in routing.slot_table(rows).orderBy("pos").collect()] == [("W", 0, "b"), ("W", 1, "a")] and rows.first()["context_slots"] == []
    assert routing.read_catalog(spark).count() == 9


def test_packages_of_all_kinds(spark):
    import io
    import zipfile

    from caseflow.sources import packages

    def pack(section="<s><p><t>a</t></p><tbl><tr><tc><cellSpan colSpan='2'/><t>b</t><t>c</t></tc></tr></tbl><pic/></s>", **other):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, data in ({"mimetype": "application/hwp+zip", "Contents/content.hpf": "<x/>", "Contents/header.xml": "<x/>", "Contents/section0.xml": section} | other).items():
                if data is not None:
                    z.writestr(name, data)
        return buffer.getvalue()

    good = pack()
    files = spark.createDataFrame([("good", good), ("none", None), ("text", b"x"), ("bad", pack("<s>")), ("dtd", pack("<!DOCTYPE s><s/>")), ("type", pack(mimetype="text/plain")), ("name", pack(**{"../x": "1"})), ("empty", pack(**{"Contents/section0.xml": None}))], "path string, content binary")
    got = {r["path"]: r["errors"] for r in packages.validate_packages(files).collect()}
    assert got == {"good": [], "none": ["NOT_A_PACKAGE"], "text": ["NOT_A_PACKAGE"], "bad": ["XML:Contents/section0.xml"], "dtd": ["XML_DECLARATION:Contents/section0.xml"], "type": ["MIMETYPE"], "name": ["UNSAFE_NAME"], "empty": ["NO_SECTION"]}
    rows = packages.extract_package_tables(files).orderBy("kind").collect()
    assert [(r["kind"], r["id"], r["column_span"], r["text"]) for r in rows] == [("cell", "section0.table0.row0.cell0", 2, "bc"), ("object", "section0.object9", None, "pic"), ("paragraph", "section0.paragraph0", None, "a")]
    other = pack("<s><p><t>other words</t></p><tbl><tr><tc><cellSpan colSpan='2'/><t>b</t><t/></tc></tr></tbl><pic/></s>")
    indented = pack("""<s>
      <p><t>more</t></p> <tbl><tr><tc><cellSpan colSpan='2'/><t>b</t><t>c</t></tc></tr></tbl>
      <pic/></s>""")
    prints = [packages.layout_fingerprint(packages.read_package(c)) for c in (good, other, indented, pack("<s/>"))]
    assert prints[0] == prints[1] == prints[2] != prints[3]


def test_formats_by_whole_content(spark):
    import io
    import zipfile

    def zipped(**parts):
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as z:
            for name, data in parts.items():
                z.writestr(name, data)
        return buffer.getvalue()

    form = {"mimetype": "application/hwp+zip", "Contents/section0.xml": "<s/>"}
    want = {
        b"%PDF-1.4 x": "PDF", bytes.fromhex("D0CF11E0A1B11AE1") + b"x": "HWP_CANDIDATE", zipped(**form): "ZIP_PACKAGE", zipped(mimetype="text/plain", **{"Contents/section0.xml": ""}): "UNKNOWN", zipped(mimetype="application/hwp+zip"): "UNKNOWN",
        b"PK not a zip": "UNKNOWN", b"<a><b></a>": "UNKNOWN", b"<a>" + b"x" * 5000 + b"</a><!DOCTYPE a>": "UNKNOWN", b"<a>" + b"x" * 5000 + b"</a>": "XML", b"<!doctype a><a/>": "UNKNOWN", b"": "UNKNOWN", None: "UNKNOWN", "<?xml version='1.0' encoding='UTF-16'?><a>é</a>".encode("utf-16"): "XML",
    }
    rows = spark.createDataFrame(list(enumerate(want)), "i int, content binary").select("i", phrases.detect_format(F.col("content")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in rows} == dict(enumerate(want.values()))


def test_anchors_widen_to_any_length(spark):
    from caseflow.operators.discovery import unique_anchor

    long = "ab" * 300_000 + "X" + "ab" * 300_000
    rows = spark.createDataFrame([(0, "one two one two three", 4, 7), (1, long, 0, 2), (2, "aaaa", 1, 2), (3, "", 0, 0), (4, None, 0, 0)], "i int, text string, a int, b int")
    got = {r["i"]: r["x"] for r in rows.select("i", unique_anchor(F.col("text"), F.col("a"), F.col("b")).alias("x")).collect()}

    def plain(text, a, b):
        pad = 16
        while True:
            part = text[max(0, a - pad) : b + pad]
            if part == text or len(text) - len(text.replace(part, "")) == len(part):
                return part
            pad *= 2

    assert got[0] == plain("one two one two three", 4, 7) and got[1] == plain(long, 0, 2) and got[2] == "aaaa" and not got[3] and got[4] is None
