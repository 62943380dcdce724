"""Registered queries of form cells, rendered regions, edits, audits, records and snapshots over whole tables, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions import fields as ff
from caseflow.operators import audit, forms, records, regions
from caseflow.plans.common import CELLS_SQL, cell_lines, cells, joined, pick, table
from caseflow.sources import phrases


def _o() -> Column:
    return F.col("o_orderkey")


def _e() -> Column:
    return F.col("event_id")


def _d() -> Column:
    return F.col("doc_id")



def official_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.official_region(cells(spark, sf_dir)).select("doc_id", "start_row", "n_cells")


def date_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.date_triplets(cells(spark, sf_dir)).select("doc_id", "row", "label", joined(F.transform("columns", lambda c: c.cast("string"))).alias("columns"))


def label_to_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.label_to_left(cells(spark, sf_dir)).select("doc_id", "row", F.col("column").cast("long").alias("column"), "unit", "label")


def next_existing_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.next_existing_row(cells(spark, sf_dir)).select("doc_id", "row", "next_row")


def _spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    return regions.spatial_below(rows.withColumn("text", F.when((F.col("column") == 0) & (F.col("row") % 3 == 0), "").otherwise(F.col("text"))))


def spatial_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spatial(spark, sf_dir).select("doc_id", "label_row", "row", F.col("column").cast("long").alias("column"))


def prefer_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    adjacent = forms.label_blank_pairs(cells(spark, sf_dir))
    adjacent = adjacent.select("doc_id", "table_id", F.col("row").alias("label_row"), "label_column", "label", "row", "column")
    both = regions.prefer_spatial(_spatial(spark, sf_dir), adjacent)
    return both.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("column").cast("long").alias("columns"))


def known_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.known_label_cells(cells(spark, sf_dir)).select("doc_id", "row", F.col("column").cast("long").alias("column"), "label")


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part as a box on a page of its brand."""
    p = F.col("p_partkey")
    x, y = (p * 37 % 400).cast("double"), (p * 53 % 600).cast("double")
    return table(spark, sf_dir, "part").select(p.alias("id"), (F.col("p_size") % 5).alias("doc_id"), (p % 3).alias("page"), x.alias("x0"), y.alias("y0"), (x + 10 + F.col("p_size")).alias("x1"), (y + 8 + p % 7).alias("y1"))


def overlap_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return regions.overlap_regions(boxes.where("id % 2 = 0").withColumnRenamed("id", "change_id"), boxes.where("id % 2 = 1").withColumnRenamed("id", "region_id"))


def nearest_input_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = _boxes(spark, sf_dir)
    return regions.nearest_input_region(boxes.where("id % 2 = 0").withColumnRenamed("id", "label_id"), boxes.where("id % 2 = 1").withColumnRenamed("id", "cell_id"))


def reconcile_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes as fields of three kinds that point at a third of the cells."""
    found = nearest_input_region(spark, sf_dir)
    i = F.col("id")
    fields = _boxes(spark, sf_dir).where("id % 2 = 0").select("doc_id", i.alias("field_id"), i.alias("label_id"), F.when(i % 6 == 0, "date_segments").when(i % 6 == 2, "blank").otherwise("checkbox").alias("kind"), (i % 300).alias("target"))
    return regions.reconcile_fields(fields, found)


def union_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).withColumn("field_id", F.col("id") % 40).withColumn("x0", F.col("x0") + 0.25).withColumn("x1", F.col("x1") + 0.25)
    return regions.union_regions(rows)


def _ordinals(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """An order's lines as cells, and as rendered regions: some lost, cut or changed."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    text = F.concat(F.lit("Part no. "), (F.col("p") * 7919).cast("string"))
    base = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("ordinal"), F.concat_ws(".", "l_orderkey", "l_linenumber").alias("cell_id"), text.alias("text"), "p", "q")
    seen = F.when(F.col("p") % 11 == 0, "other words entirely").when(F.col("p") % 5 == 0, F.upper(F.replace("text", F.lit(" "), F.lit("")))).otherwise(F.col("text"))
    return base.select("doc_id", "ordinal", "cell_id", "text"), base.where("p % 13 != 0").select("doc_id", "ordinal", seen.alias("text"), (F.col("q") > 48).alias("overflow"))


def zip_cells_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.zip_cells_regions(*_ordinals(spark, sf_dir))


def review_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as regions before and after an edit that moves, overflows and loses some."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"), F.max("l_quantity").alias("q"))
    x = F.col("p").cast("double")
    box = lambda dx: [(x + dx).alias("x0"), F.col("q").alias("y0"), (x + 10 + dx).alias("x1"), (F.col("q") + 5).alias("y1")]
    base = lines.withColumns({"doc_id": F.col("l_orderkey"), "cell_id": F.concat_ws(".", "l_orderkey", "l_linenumber"), "page": F.col("l_linenumber") % 2})
    before = base.select("doc_id", "cell_id", "page", *box(F.lit(0.0)), F.lit("").alias("text"), (F.col("q") > 45).alias("overflow"))
    after = base.where("p % 17 != 0").select("doc_id", "cell_id", "page", *box(F.when(F.col("p") % 9 == 0, 0.75).otherwise(0.25)), F.concat(F.lit("No-"), F.col("p").cast("string")).alias("text"), (F.col("q") > 40).alias("overflow"))
    fields = base.where("p % 4 = 0").select("doc_id", F.col("cell_id").alias("field_id"), "cell_id", F.when(F.col("p") % 8 == 0, F.concat(F.lit("NO "), F.col("p").cast("string"))).otherwise("absent").alias("value"))
    return regions.review_regions(before, after, fields)


def compare_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select((F.col("page_id") % 50).alias("doc_id"), F.col("page_id").alias("page"), F.sha2("html", 256).alias("sha256"))
    after = pages.where("page % 7 != 0").withColumn("sha256", F.when(F.col("page") % 5 == 0, "changed").otherwise(F.col("sha256")))
    return regions.compare_pages(pages, after)


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as an edit of two cells."""
    value = F.when(_o() % 5 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(_o() % 5 == 3, (_o() * 7).cast("string")).when(_o() % 5 == 0, (_o() % 90 + 10).cast("string")).otherwise(F.col("o_orderpriority"))
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("doc_id"), _o().alias("field_id"), pick(["write_character_grid", "set_date_segments", "set_checkbox", "set_amount", "replace_text"], _o()).alias("operation"), value.alias("new_value"),
        F.when(_o() % 5 == 2, "[ ]").when(_o() % 5 == 3, "원").alias("anchor"), F.when(_o() % 5 == 1, "inline").when(_o() % 5 == 3, "prefix_unit").alias("mode"), F.array().cast("array<string>").alias("separators"),
        F.array(F.concat(_o().cast("string"), F.lit("a")), F.concat(_o().cast("string"), F.lit("b"))).alias("cell_ids"), "o_orderdate", "o_orderpriority",
    )


def check_typed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells after the edits; a third of them hold something else."""
    edits = _edits(spark, sf_dir)
    f, bad = F.col("field_id"), F.col("field_id") % 3 == 0
    a = F.when(f % 5 == 0, F.substring("new_value", 1, 1)).when(f % 5 == 2, F.when(bad, "[V] [ ]").otherwise("[V] yes")).when(f % 5 == 3, F.concat("new_value", F.when(bad, "").otherwise("원"))).otherwise(F.when(bad, "none").otherwise(F.col("new_value")))
    b = F.when(f % 5 == 0, F.when(bad, "").otherwise(F.substring("new_value", 2, 1))).otherwise("")
    texts = edits.select("doc_id", F.explode(F.array(F.struct(F.col("cell_ids")[0].alias("cell_id"), a.alias("text")), F.struct(F.col("cell_ids")[1].alias("cell_id"), b.alias("text")))).alias("c")).select("doc_id", "c.*")
    return regions.check_typed_edits(edits.drop("o_orderdate", "o_orderpriority"), texts)


def check_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, lines as fields: views by line, cited ones by quantity."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    d, n = F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field_id")
    view = lambda kind: F.concat(F.lit(kind), F.col("l_linenumber").cast("string"))
    views = lines.select(d, n, F.explode(F.when(F.col("p") % 2 == 0, F.array(F.struct(F.lit("full").alias("kind"), view("f").alias("view_id")), F.struct(F.lit("detail").alias("kind"), view("d").alias("view_id")))).otherwise(F.array(F.struct(F.lit("full").alias("kind"), view("f").alias("view_id"))))).alias("v")).select("doc_id", "field_id", "v.*")
    p = F.col("p")
    cited = F.when(p % 7 == 0, F.array().cast("array<string>")).when(p % 7 == 1, F.array(F.lit("zz"))).when(p % 7 == 2, F.array(F.lit("f1"), F.lit("f2"))).when(p % 7 == 3, F.array(view("d"))).when(p % 7 == 4, F.array(view("f"))).otherwise(F.array(view("f"), view("d")))
    return regions.check_evidence(lines.select(d, n, cited.alias("view_ids")), views)


def check_expected_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), _o().alias("item_id"))
    return forms.check_expected_changes(o.where("item_id % 3 != 0"), o.where("item_id % 4 != 0"))


def manifest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), pick(["paragraph", "table", "image"], F.col("l_partkey")).alias("kind"), "l_linenumber")
    both = forms.same_shape(forms.manifest_counts(items), forms.manifest_counts(items.where("l_linenumber < 6")))
    return both.select("doc_id", *[f"n_{k}s" for k in ("paragraph", "table", "image")], "same_shape")


def active_approval(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), _o().alias("plan_id"), F.col("o_orderdate").alias("created_at"), "o_orderstatus")
    plans = forms.current_plan(o.drop("o_orderstatus"))
    approvals = o.select("doc_id", "plan_id", F.explode(F.array(F.col("plan_id") * 2, F.col("plan_id") * 2 + 1)).alias("approval_id")).withColumn("revoked_at", F.when(F.col("approval_id") % 3 == 0, "x"))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), pick(["APPROVED", "DRAFT", "VERIFIED_FINAL"], F.col("c_custkey")).alias("status"))
    return audit.active_approval(approvals, plans, documents)


def finalizable_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), _o().alias("plan_id"), F.col("o_orderdate").alias("created_at"))
    plans = forms.current_plan(o)
    reviews = o.select("doc_id", "plan_id", (F.col("plan_id") % 2).alias("review_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")).withColumn("verdict", pick(["PASS", "FAIL", "NEEDS_HUMAN"], F.col("plan_id") + F.col("seq")))
    documents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.when(F.col("c_custkey") % 2 == 0, "PENDING_VISION_REVIEW").otherwise("DRAFT").alias("status"))
    return audit.finalizable_documents(documents, plans, reviews)


def attempt_document_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(
        _o().alias("attempt_id"), pick(["RESERVED", "FAILED", "RESERVED", None], _o()).alias("was"), pick(["ABORTED_NO_OUTPUT", "FAILED", "PENDING_VISION_REVIEW", "VERIFIED_FINAL", "odd"], _o()).alias("status"),
        F.when(_o() % 7 != 0, "m").alias("modified_sha256"), F.when(_o() % 3 != 0, "r").otherwise("").alias("report_sha256"),
    )
    return audit.attempt_document_status(rows).select("attempt_id", "document_status", "error")


def check_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as fields, chosen and edited by their part."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("field_id"), "p")
    p = F.col("p")
    registry = rows.where("p % 29 != 0").select("doc_id", "field_id", pick(["text_field", "text_field", "official_region", "signable_region"], p).alias("kind"), F.lit("now").alias("current_text"))
    wish = F.when(p % 4 == 2, F.when(p % 5 == 0, "provided").otherwise("intentionally_blank")).when(p % 4 == 3, F.when(p % 5 == 0, "provided").otherwise("manual_after_export")).otherwise("provided")
    dispositions = rows.where("p % 31 != 0").select("doc_id", "field_id", wish.alias("disposition"))
    edits = rows.where("p % 4 < 2 and p % 7 != 0").select("doc_id", "field_id", F.when(p % 11 == 0, "then").otherwise("now").alias("expected_text"))
    return audit.check_plan(registry, dispositions, edits)


def validate_edit_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = pick(["date_segments", "checkbox", "character_grid", "number", "phone", "amount", "text_field"], _o())
    value = F.when(_o() % 7 == 0, F.when(_o() % 2 == 0, F.date_format("o_orderdate", "yyyy/M/d")).otherwise("2026-02-30")).when(_o() % 7 == 2, (_o() % 1000).cast("string")).when(_o() % 7 == 4, F.concat(F.lit("+82 10-"), _o().cast("string"))).when(_o() % 3 == 0, F.lit("1,000")).otherwise((_o() % 100).cast("string"))
    rows = table(spark, sf_dir, "orders").select(_o(), kind.alias("kind"), value.alias("value"), (_o() % 3 + 1).alias("n_segments"), pick(["inline", "odd"], F.floor(_o() / 3)).alias("mode"), F.lit("[ ]").alias("anchor"), F.repeat(F.lit("[ ] "), (_o() % 3).cast("int")).alias("current_text"), F.lit(2).alias("slot_count"))
    return audit.validate_edit_inputs(rows).select("o_orderkey", "error")


def verify_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select((_d() % 900).alias("plan_id"), F.sha2("text", 256).alias("found"), F.when(_d() % 13 == 0, "x").otherwise(F.sha2("text", 256)).alias("recorded"))
    return audit.verify_integrity(rows, hash_col="found", expected_col="recorded", id_col="plan_id")


def progress_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("case_id"), _e(), F.col("ts").alias("at"), F.col("event_type").alias("step"))
    return audit.progress_timeline(rows).select("event_id", F.col("position").cast("long").alias("position"), F.col("phase").cast("long").alias("phase"), "is_last")


def hybrid_fuse_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    rows = events.select(F.col("user_id").alias("request_id"), F.col("event_type").alias("query_kind"), pick(["dense", "sparse"], _e()).alias("branch"), (_e() % 41).alias("point_id"), (_e() % 40).alias("rank"))
    found = audit.hybrid_fuse_store(rows)
    return found.select("request_id", "query_kind", "point_id", F.round("score", 9).alias("score"))


def assign_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' types as keys of a user's record; seven rules; the cells after them."""
    record = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("record_id"), F.col("event_type").alias("key")).agg(F.max("event_id").alias("e"))
    record = record.select("record_id", "key", F.when(F.col("e") % 6 == 0, "").otherwise(F.concat(F.lit("v-"), F.col("e").cast("string"))).alias("value"))
    rules = spark.createDataFrame(
        [(1, ["view", "click"], False, None, "set", None, None), (2, ["none", "signup"], True, None, "append", None, None), (3, ["error"], True, 1, "prepend", None, None), (4, ["purchase"], True, 9, "set", None, None), (5, ["click"], False, None, "replace", "_", "<{value}>"), (6, ["none"], False, None, "set", None, None), (7, ["view"], False, None, "replace", "?", "x")],
        "rule_id int, keys array<string>, digits_only boolean, value_index int, operation string, marker string, replacement string",
    ).withColumns({"table": F.lit(0), "row": F.col("rule_id"), "column": F.lit(1)})
    cell = rules.select("table", "row", "column", F.lit("a_b").alias("text"))
    assigned = records.assign_cells(record, rules)
    done = records.apply_assignments(assigned, cell)
    return assigned.select("record_id", "rule_id", "value", "error").join(done.select("record_id", "rule_id", "text", "changed", F.col("error").alias("cell_error")), ["record_id", "rule_id"], "left")


def map_template_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's latest event of each type as slots; a mapping with priorities, a constant and a mirror."""
    held = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("case_id"), F.col("event_type").alias("key")).agg(F.max("event_id").alias("e"))
    held = held.select("case_id", "key", F.when(F.col("e") % 4 == 0, "").otherwise(F.col("e").cast("string")).alias("value"))
    mapping = spark.createDataFrame(
        [("T1", "first", 1, "view", None, None), ("T1", "first", 2, "click", None, None), ("T1", "country", 1, None, "KR", None), ("T1", "again", 9, None, None, "first"), ("T1", "signup", 1, "error", None, None)],
        "template_id string, field string, priority int, source string, constant string, mirror_of string",
    )
    return records.map_template_fields(held, mapping)


def fill_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cells(spark, sf_dir)
    asked = F.explode(F.array(F.struct(F.lit("name").alias("key"), F.lit("성 명").alias("label")), F.struct(F.lit("firm").alias("key"), F.lit("업체명(x)").alias("label"))))
    values = cell_lines(spark, sf_dir).select("doc_id").distinct().select("doc_id", asked.alias("v"), F.lit("x").alias("value"))
    found = records.fill_by_label(rows, values.select("doc_id", "v.*", "value"), below=["name"])
    return found.select("doc_id", "row", F.col("column").cast("long").alias("column"), "key")


def mark_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_partkey").alias("p"))
    boxes = lines.select(F.col("l_orderkey").alias("doc_id"), F.lit(0).alias("table_id"), F.col("l_linenumber").alias("row"), F.lit(0).alias("column"), F.concat(pick(["[ ] ", "□", ""], F.col("p")), pick(["Yes", "NO", "Maybe"], F.col("p"))).alias("text"))
    options = table(spark, sf_dir, "orders").select(_o().alias("doc_id"), pick(["yes", "No!", "none"], _o()).alias("label"))
    return records.mark_options(boxes, options).select("doc_id", "row", "text")


def bulk_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = ff.bulk_replace(F.col("text"), F.lit("the "), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", done.alias("r")).select("doc_id", F.md5("r.text").alias("text"), F.col("r.replaced").cast("long").alias("replaced"), "r.error")


def kv_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as record texts: a line is a pair, some are broken."""
    text = F.concat(F.lit("# c\n"), F.when(_d() % 5 == 0, "=x\n").when(_d() % 5 == 1, "k\n").when(_d() % 5 == 2, "").otherwise("lang=zz\nn = 1\n"), F.concat(F.lit("lang= "), "lang", F.lit("\n\nlines=a=b\n")))
    rows = phrases.parse_kv_rows(table(spark, sf_dir, "documents").select(_d().alias("record_id"), F.concat(text, F.lit("text="), F.translate("text", "\n", " ")).alias("text")))
    return rows.select("record_id", "key", F.md5("value").alias("value"), "error")


def html_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The navigation's entries of every page."""
    return phrases.extract_html_rows(table(spark, sf_dir, "pages").select("page_id", F.replace("html", F.lit("</a>"), F.lit("</a><a>n</a>")).alias("html")), block="nav", row="li", cell="a", at=1, skip_header=False).select("page_id", F.col("pos").cast("long").alias("pos"), "source", "translation")


def detect_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    escaped = F.replace(F.replace("html", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    element = F.concat(F.lit("<page>"), escaped, F.lit("</page>"))
    content = F.when(p % 5 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).when(p % 5 == 1, F.concat(F.lit("PK"), "html")).when(p % 5 == 2, F.concat(F.lit("<?xml version='1.0'?>"), element)).when(p % 5 == 3, F.concat(element, F.lit("<!DOCTYPE a>"))).otherwise(F.col("html"))
    return table(spark, sf_dir, "pages").select("page_id", phrases.detect_format(F.encode(content, "UTF-8")).alias("format"))


def embedded_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References put into every page, read back and taken out again."""
    p = F.col("page_id")
    with_ref = phrases.add_embedded_ref(F.col("html"), F.upper(F.sha2("html", 256)), F.when(p % 3 == 0, -1).otherwise(p))
    rows = table(spark, sf_dir, "pages").select("page_id", "html", with_ref.alias("w"))
    ref = phrases.read_embedded_ref(F.col("w"))
    return rows.select("page_id", ref["snapshot_ref"].alias("ref"), ref["section"].cast("long").alias("section"), (phrases.strip_embedded_ref(F.col("w")) == F.col("html")).alias("restored"))


def _uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.concat_ws("/", "lang", "source", (F.col("n_chars") % 50).cast("string")).alias("name"), F.sha2("text", 256).alias("document_hash"), F.sha2("text", 256).alias("fingerprint"), "doc_id")


def resolve_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    uploads = _uploads(spark, sf_dir)
    stored, aliases = phrases.store_snapshots(uploads)
    requests = uploads.select(_d().alias("request_id"), F.when(_d() % 3 == 0, F.upper("document_hash")).when(_d() % 11 == 0, "bad").when(_d() % 7 == 0, F.repeat(F.lit("0"), 64)).alias("ref"), "name")
    return phrases.resolve_snapshot(requests, stored, aliases)


def identify_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(_d().alias("file_id"), F.sha2("text", 256).alias("sha256"))
    templates = files.where("file_id % 3 = 0").select(F.col("file_id").alias("template_id"), "sha256")
    return phrases.identify_template(files, templates)


def verify_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").alias("uri"), F.sha2("html", 256).alias("sha256"), F.octet_length("html").cast("long").alias("size"))
    actual = rows.where("uri % 7 != 0").withColumn("size", F.when(F.col("uri") % 5 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return phrases.verify_artifacts(rows.where("uri % 11 != 0"), actual)


QUERIES = {
    f.__name__: f
    for f in (
        official_region, date_triplets, label_to_left, next_existing_row, spatial_below, prefer_spatial, known_labels, overlap_regions, nearest_input_region, reconcile_fields, union_regions, zip_cells_regions, review_regions, compare_pages, check_typed_edits, check_evidence,
        check_expected_changes, manifest_counts, active_approval, finalizable_documents, attempt_document_status, check_plan, validate_edit_inputs, verify_integrity, progress_timeline, hybrid_fuse_store, assign_cells, map_template_fields, fill_by_label,
        mark_options, bulk_replace, kv_records, html_rows, detect_format, embedded_refs, resolve_snapshot, identify_template, verify_artifacts,
    )
}

_LINES = "l as (select l_orderkey as d, l_linenumber as n, max(l_partkey) as p, max(l_quantity) as q from lineitem group by 1, 2)"
_BOXES = "b as (select p_partkey as id, p_size % 5 as doc_id, p_partkey % 3 as page, (p_partkey * 37 % 400)::double as x0, (p_partkey * 53 % 600)::double as y0, x0 + 10 + p_size as x1, y0 + 8 + p_partkey % 7 as y1 from part)"
_PLANS = "cur as (select o_custkey as doc_id, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as plan_id from orders group by 1)"
_SPACE = f"""{CELLS_SQL}, sc as (select doc_id, "row", "column", case when "column" = 0 and "row" % 3 = 0 then '' else text end as text from cells), nx as (select doc_id, "row", lead("row") over (partition by doc_id order by "row") as nr from (select distinct doc_id, "row" from cells)),
sp as (select s.doc_id, s."row" as label_row, s."column" as label_column, t."row", min(t."column") as "column" from sc s join nx on nx.doc_id = s.doc_id and nx."row" = s."row" join sc t on t.doc_id = s.doc_id and t."row" = nr and t."column" in (s."column", s."column" - 1) and t.text = '' where s.text = '성명' group by 1, 2, 3, 4)"""
_ADJ = """adj as (select * from (select doc_id, "row" as label_row, "column" as label_column, text, lead(text) over w as nt, lead("column") over w as nc from cells window w as (partition by doc_id, "row" order by "column")) where text != '' and nt = '')"""
_NEXT_TO = "greatest(0, least({a1}, {b1}) - greatest({a0}, {b0}))"
_NEAREST = f"""with {_BOXES}, j as (select a.doc_id, a.page, a.id as label_id, r.id as cell_id, {_NEXT_TO.format(a0='a.x0', a1='a.x1', b0='r.x0', b1='r.x1')} / greatest(1, least(a.x1 - a.x0, r.x1 - r.x0)) as across, {_NEXT_TO.format(a0='a.y0', a1='a.y1', b0='r.y0', b1='r.y1')} / greatest(1, least(a.y1 - a.y0, r.y1 - r.y0)) as along, r.y0 - a.y1 as down, r.x0 - a.x1 as beside,
  least(a.x1 - a.x0, r.x1 - r.x0) / greatest(1, a.x1 - a.x0, r.x1 - r.x0) as sw, least(a.y1 - a.y0, r.y1 - r.y0) / greatest(1, a.y1 - a.y0, r.y1 - r.y0) as sh from b a join b r on a.doc_id = r.doc_id and a.page = r.page and a.id % 2 = 0 and r.id % 2 = 1),
k as (select *, across >= 0.6 and down between -0.5 and 3 as is_below, along >= 0.6 and beside between -0.5 and 3 as is_right from j), o as (select *, row_number() over (partition by doc_id, page, label_id order by case when is_below then -sw else -sh end, case when is_below then down else beside end, case when is_below then -across else -along end, not is_below, cell_id) as rn from k where is_below or is_right)
select doc_id, page, label_id, cell_id, case when is_below then 'below' else 'right' end as relation from o where rn = 1"""
ORACLE_SQL = {
    "official_region": f"""with {CELLS_SQL}, s as (select doc_id, min("row") as start_row from cells where text = '결재' group by 1) select doc_id, start_row, count(*) as n_cells from cells join s using (doc_id) where "row" >= start_row group by 1, 2""",
    "date_triplets": f"""with {CELLS_SQL}, a as (select doc_id, "row", min(case when contains(text, 'yyyy') then "column" end) as y, min(case when contains(text, 'mm') then "column" end) as m, min(case when contains(text, 'dd') then "column" end) as d from cells group by 1, 2) select doc_id, "row", '날짜' as label, y || ',' || m || ',' || d as columns from a where y is not null and m is not null and d is not null""",
    "label_to_left": f"""with {CELLS_SQL}, l as (select *, last_value(case when text != '' then text end ignore nulls) over (partition by doc_id, "row" order by "column" rows between unbounded preceding and 1 preceding) as lab from cells) select doc_id, "row", "column", text as unit, coalesce(lab, '금액') as label from l where text = '원'""",
    "next_existing_row": f'with {CELLS_SQL} select doc_id, "row", lead("row") over (partition by doc_id order by "row") as next_row from (select distinct doc_id, "row" from cells)',
    "spatial_below": f'with {_SPACE} select doc_id, label_row, "row", "column" from sp',
    "prefer_spatial": f'with {_SPACE}, {_ADJ} select doc_id, count(*) as n, sum(c)::bigint as columns from (select doc_id, "column" as c from sp union all select doc_id, nc from adj anti join sp using (doc_id, label_row, label_column)) group by 1',
    "known_labels": f"""with {CELLS_SQL}, n as (select *, lead(text) over w as nt, lag(text) over w as pt from cells window w as (partition by doc_id, "row" order by "column")) select doc_id, "row", "column", text as label from n where text in ('성명', '업체명') and not coalesce(nt = '', false)""",
    "overlap_regions": f"with {_BOXES} select a.doc_id, a.page, a.id as change_id, r.id as region_id from b a join b r on a.doc_id = r.doc_id and a.page = r.page and a.id % 2 = 0 and r.id % 2 = 1 and a.x0 < r.x1 and r.x0 < a.x1 and a.y0 < r.y1 and r.y0 < a.y1",
    "nearest_input_region": _NEAREST,
    "reconcile_fields": f"""with near as ({_NEAREST}), {_BOXES}, f as (select doc_id, id as field_id, case id % 6 when 0 then 'date_segments' when 2 then 'blank' else 'checkbox' end as kind, id % 300 as target from b where id % 2 = 0),
p as (select f.doc_id, field_id, kind, case when kind != 'checkbox' and cell_id is not null then cell_id else target end as target, case when kind != 'checkbox' then relation end as relation from f left join near on near.doc_id = f.doc_id and near.label_id = f.field_id),
k as (select * from p where kind = 'date_segments' or (doc_id, target) not in (select (doc_id, target) from p where kind = 'date_segments'))
select doc_id, field_id, kind, target, relation, count(*) over (partition by doc_id, kind, target) > 1 as ambiguous from k qualify row_number() over (partition by doc_id, kind, target order by case relation when 'below' then 2 when 'right' then 1 else 0 end desc, field_id) = 1""",
    "union_regions": f"with {_BOXES}, u as (select doc_id, id % 40 as field_id, page, floor(min(x0 + 0.25))::bigint as a, floor(min(y0))::bigint as b, ceil(max(x1 + 0.25))::bigint as c, ceil(max(y1))::bigint as d from b group by 1, 2, 3) select doc_id, field_id, page, 'page_' || lpad(page::varchar, 3, '0') || ':' || a || ',' || b || ',' || c || ',' || d as region from u",
    "zip_cells_regions": f"with {_LINES}, s as (select d as doc_id, count(*) as n_cells, sum((p % 13 != 0)::int)::bigint as n_regions, sum((p % 13 != 0 and p % 11 = 0)::int)::bigint as n_mismatched, sum((p % 13 != 0 and q > 48)::int)::bigint as n_overflowing from l group by 1) select *, case when n_cells = n_regions and n_mismatched = 0 then 'MAPPED' else 'NEEDS_HUMAN' end as status from s",
    "review_regions": f"""with {_LINES}, s as (select d as doc_id, sum((p % 17 != 0 and p % 9 = 0)::int)::bigint as n_moved, sum((p % 17 != 0 and q > 40 and q <= 45)::int)::bigint as n_new_overflow, count(distinct n % 2) as n_pages_before, count(distinct case when p % 17 != 0 then n % 2 end) as n_pages_after, sum((p % 4 = 0 and p % 17 = 0)::int)::bigint as n_unmapped, sum((p % 4 = 0 and (p % 17 = 0 or p % 8 != 0))::int)::bigint as n_hidden from l group by 1)
select *, n_moved = 0 and n_new_overflow = 0 and n_pages_before = n_pages_after and n_unmapped = 0 and n_hidden = 0 as passed from s""",
    "compare_pages": "select page_id % 50 as doc_id, page_id as page, page_id % 7 != 0 and page_id % 5 != 0 as same from pages",
    "check_typed_edits": "select o_custkey as doc_id, o_orderkey as field_id, ['character_grid', 'date_segments', 'checkbox_marker', 'amount', 'value_once'][o_orderkey % 5 + 1] as failure from orders where o_orderkey % 3 = 0",
    "check_evidence": f"""with {_LINES}, c as (select *, p % 2 = 0 as det from l), v as (select c.*, (select count(*) from l x where x.d = c.d and x.n = 1) as h1, (select count(*) from l x where x.d = c.d and x.n = 2) as h2 from c)
select d as doc_id, n as field_id, case p % 7 when 0 then 'EVIDENCE_MISSING' when 1 then 'UNKNOWN_VIEW' when 2 then case when h1 = 0 or h2 = 0 then 'UNKNOWN_VIEW' else 'VIEW_OF_OTHER_FIELD' end when 3 then case when not det then 'UNKNOWN_VIEW' else 'FULL_PAGE_REQUIRED' end when 4 then case when det then 'DETAIL_REQUIRED' end else case when not det then 'UNKNOWN_VIEW' end end as error from v""",
    "check_expected_changes": "select o_custkey as doc_id, o_orderkey as item_id, case when o_orderkey % 3 != 0 then 'unexpected' else 'missing' end as problem from orders where (o_orderkey % 3 != 0) != (o_orderkey % 4 != 0)",
    "manifest_counts": "with m as (select l_orderkey as d, " + ", ".join(f"sum((l_partkey % 3 = {i})::int)::bigint as n_{k}s, sum((l_partkey % 3 = {i} and l_linenumber < 6)::int)::bigint as m{i}" for i, k in enumerate(("paragraph", "table", "image"))) + " from lineitem group by 1) select d as doc_id, n_paragraphs, n_tables, n_images, n_paragraphs = m0 and n_tables = m1 and n_images = m2 and m0 + m1 + m2 > 0 as same_shape from m",
    "active_approval": f"with {_PLANS}, a as (select doc_id, plan_id, unnest([plan_id * 2, plan_id * 2 + 1]) as a from cur) select doc_id, plan_id, max(a) as approval_id from a where a % 3 != 0 and doc_id % 3 != 1 and doc_id in (select c_custkey from customer) group by 1, 2",
    "finalizable_documents": f"with {_PLANS} select doc_id, case when (plan_id + 2) % 3 = 0 then 'VERIFIED_FINAL' else 'NEEDS_HUMAN' end as status from cur where doc_id % 2 = 0 and doc_id in (select c_custkey from customer)",
    "attempt_document_status": "with a as (select o_orderkey as k, ['RESERVED', 'FAILED', 'RESERVED', null][o_orderkey % 4 + 1] as was, o_orderkey % 5 as s from orders), e as (select *, case when coalesce(was, '') != 'RESERVED' then 'ATTEMPT_NOT_RESERVED' when s in (1, 2) and (k % 7 = 0 or k % 3 = 0) then 'OUTPUT_DIGESTS_REQUIRED' when s = 4 then 'UNKNOWN_STATUS' end as error from a) select k as attempt_id, case when error is null then ['APPROVED', 'NEEDS_HUMAN', 'PENDING_VISION_REVIEW', 'VERIFIED_FINAL', null][s + 1] end as document_status, error from e",
    "check_plan": f"""with {_LINES}, r as (select d as doc_id, n as field_id, p, p % 29 != 0 as has, p % 31 != 0 as disp, p % 4 as k, p % 4 < 2 and p % 7 != 0 as ed from l), e as (select doc_id, field_id, case when not has and not disp and not ed then null when not has then 'UNKNOWN_FIELD' when not disp then 'DISPOSITION_MISSING' when k = 2 and p % 5 = 0 then 'OFFICIAL_NOT_BLANK' when k = 3 and p % 5 = 0 then 'SIGNATURE_NOT_MANUAL'
  when k < 2 and not ed then 'PROVIDED_WITHOUT_EDIT' when ed and p % 11 = 0 then 'TEXT_CHANGED' end as error from r) select * from e where error is not null""",
    "validate_edit_inputs": """with o as (select o_orderkey as k, case when o_orderkey % 3 = 0 then '1,000' else (o_orderkey % 100)::varchar end as v from orders) select k as o_orderkey, case k % 7 when 0 then case when k % 2 = 1 then 'DATE_INVALID' when k % 3 = 1 or (k % 3 = 0 and (k // 3) % 2 = 1) then 'DATE_SEGMENTS' end when 1 then case when k % 3 != 1 then 'CHECKBOX_ANCHOR' end
  when 2 then case when length((k % 1000)::varchar) != 2 then 'GRID_LENGTH' end when 3 then case when v = '1,000' then 'NUMBER_FORM' end end as error from o""",
    "verify_integrity": "select doc_id % 900 as plan_id, case when bool_or(doc_id % 13 = 0) then 'HASH_MISMATCH' when count(*) > 1 then 'DUPLICATE_ID' end as error from documents group by 1",
    "progress_timeline": "with p as (select *, row_number() over w as position, (lag(event_type) over w is distinct from event_type)::int as c, lead(event_id) over w is null as is_last from events window w as (partition by user_id order by ts, event_id)) select event_id, position, (sum(c) over (partition by user_id order by ts, event_id))::bigint as phase, is_last from p",
    "hybrid_fuse_store": "with b as (select user_id as r, event_type as q, ['dense', 'sparse'][event_id % 2 + 1] as b, event_id % 41 as p, min(event_id % 40) as k from events group by all), s as (select r, q, p, list_sum(list(1.0::double / (60 + k) order by b)) as s from b group by 1, 2, 3) select r as request_id, q as query_kind, p as point_id, round(s, 9) as score from s qualify row_number() over (partition by r, q order by s desc, p) <= 30",
    "assign_cells": """with r as (select user_id as u, event_type as k, max(event_id) as e from events group by 1, 2), v as (select u, k, case when e % 6 = 0 then '' else 'v-' || e end as v from r),
a as (select u, 1 as rule, arg_min(v, case k when 'view' then 0 else 1 end) as v, null as err from v where k in ('view', 'click') group by 1 union all select u, 2, replace(v, 'v-', ''), null from v where k = 'signup' union all select u, 3, case when length(v) > 3 then substr(v, 4, 1) end, case when length(v) <= 3 then 'VALUE_TOO_SHORT' end from v where k = 'error' and v != ''
  union all select u, 4, null, 'VALUE_TOO_SHORT' from v where k = 'purchase' and v != '' union all select u, 5, v, null from v where k = 'click' union all select u, 7, v, null from v where k = 'view')
select u as record_id, rule::int as rule_id, v as value, err as error, case rule when 1 then v when 2 then 'a_b  ' || v when 3 then v || ' a_b' when 5 then 'a<' || v || '>b' when 7 then 'a_b' end as text, case when err is null then rule != 7 end as changed, case when rule = 7 then 'MARKER_NOT_FOUND' end as cell_error from a where coalesce(v, '') != '' or err is not null""",
    "map_template_fields": """with r as (select user_id as u, event_type as k, max(event_id) as e from events group by 1, 2), h as (select u, k, e::varchar as v from r where e % 4 != 0), f as (select u, arg_min(v, k = 'click') as v from h where k in ('view', 'click') group by 1), s as (select u, arg_min(v, k = 'signup') as v from h where k in ('error', 'signup') group by 1)
select u as case_id, 'T1' as template_id, 'first' as field, v as value from f union all select u, 'T1', 'again', v from f union all select distinct u, 'T1', 'country', 'KR' from r union all select u, 'T1', 'signup', v from s""",
    "fill_by_label": f"""with {CELLS_SQL}, r as (select doc_id, "row", lead("row") over (partition by doc_id order by "row") as nr from (select distinct doc_id, "row" from cells)), n as (select *, lead("column") over (partition by doc_id, "row" order by "column") as nc from cells)
select doc_id, nr as "row", "column", 'name' as key from n join r using (doc_id, "row") where text = '성명' and nr = "row" + 1 union all select doc_id, "row", nc, 'firm' from n where text = '업체명' and nc is not null""",
    "mark_options": f"with {_LINES} select d as doc_id, n as \"row\", case p % 3 when 0 then '[V] Yes' else '[V]NO' end as text from l join orders on o_orderkey = d where p % 3 = d % 3 and p % 3 != 2",
    "bulk_replace": "with r as (select doc_id, replace(text, 'the ', lang) as t, ((length(text) - length(replace(text, 'the ', ''))) // 4)::bigint as n from documents) select doc_id, md5(t) as text, n as replaced, case when n = 0 then 'NOTHING_REPLACED' end as error from r",
    "kv_records": r"""with d as (select doc_id as r, lang, doc_id % 5 as k, regexp_replace(regexp_replace(translate(text, chr(10), ' '), '^[\s\x{0B}\x{85}\p{Z}]+', ''), '[\s\x{0B}\x{85}\p{Z}]+$', '') as t from documents)
select r as record_id, unnest(['lang', 'lines', 'text']) as key, md5(unnest([lang, 'a=b', t])) as value, null as error from d where k = 2 union all select r, null, null, case k when 0 then 'EMPTY_KEY' when 1 then 'NO_EQUALS_SIGN' else 'DUPLICATE_KEY' end from d where k != 2""",
    "html_rows": r"""with b as (select page_id, regexp_extract(replace(html, '</a>', '</a><a>n</a>'), '(?is)<nav\b[^>]*>(.*?)</nav>', 1) as nav from pages), r as (select page_id, regexp_extract_all(nav, '(?is)<li\b[^>]*>(.*?)</li>', 1) as l from b),
u as (select page_id, unnest(range(len(l))) as pos, unnest(l) as li from r), c as (select page_id, pos, regexp_extract_all(li, '(?is)<a\b[^>]*>(.*?)</a>', 1) as c from u)
select page_id, pos, trim(regexp_replace(regexp_replace(c[1], '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as source, trim(c[2]) as translation from c where len(c) >= 2""",
    "detect_format": "select page_id, case when left(c, 5) = '%PDF-' then 'PDF' when left(c, 2) = 'PK' or regexp_matches(c, '(?i)<!(DOCTYPE|ENTITY)') then 'UNKNOWN' else 'XML' end as format from (select page_id, case page_id % 5 when 0 then '%PDF-1.7 ' || html when 1 then 'PK' || html when 2 then '<page>' || replace(replace(html, '&', '&amp;'), '<', '&lt;') || '</page>' when 3 then '<a/><!DOCTYPE a>' else html end as c from pages)",
    "embedded_refs": "select page_id, case when page_id % 3 != 0 then sha256(html) end as ref, case when page_id % 3 != 0 then page_id end as section, true as restored from pages",
    "resolve_snapshot": """with u as (select doc_id, lang || '/' || source || '/' || (n_chars % 50) as name, sha256(text) as h from documents), a as (select name, min(h) as f from u group by 1 having count(distinct h) = 1)
select doc_id as request_id, case when doc_id % 3 = 0 then h when doc_id % 11 = 0 or doc_id % 7 = 0 then null else f end as fingerprint, case when doc_id % 3 = 0 then null when doc_id % 11 = 0 then 'INVALID_REFERENCE' when doc_id % 7 = 0 or f is null then 'NOT_FOUND' end as error from u left join a using (name)""",
    "identify_template": "with t as (select text, min(doc_id) as id, count(*) as n from documents where doc_id % 3 = 0 group by 1) select doc_id as file_id, case when n = 1 then id end as template_id, case when n > 1 then 'AMBIGUOUS_TEMPLATE' when n is null then 'UNKNOWN_TEMPLATE' end as error from documents left join t using (text)",
    "verify_artifacts": "select page_id as uri, case when page_id % 11 = 0 then 'UNRECORDED' when page_id % 7 = 0 or page_id % 5 = 0 then 'ARTIFACT_TAMPERED' end as error from pages where page_id % 11 != 0 or page_id % 7 != 0",
}
