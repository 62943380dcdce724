"""Record files and template rules: values of a record assigned to the cells of a form, values of slots mapped to its fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.fields import apply_cell_op, label_key
from caseflow.functions.text import strip


def assign_cells(records: DataFrame, rules: DataFrame) -> DataFrame:
    """(record_id, rule_id, table, row, column, operation, marker, replacement, value, error): a rule's value is that of the first of its keys that the record has.

    Records are (record_id, key, value); rules have rule_id, keys (array, the source key first), digits_only, value_index and the cell. An empty first hit drops the rule. A place beyond
    the value is an error. Rules are a dimension, joined by key, so a record meets only the rules that name its keys.
    """
    keyed = rules.select("*", F.posexplode("keys").alias("priority", "key"))
    hits = records.join(keyed, "key")
    first = hits.withColumn("__rn", F.row_number().over(Window.partitionBy("record_id", "rule_id").orderBy("priority"))).where("__rn = 1")
    text = F.when(F.col("digits_only"), F.regexp_replace("value", "[^0-9]", "")).otherwise(F.col("value"))
    short = F.col("value_index").isNotNull() & (F.col("value_index") >= F.length(text))
    one = F.when(F.col("value_index").isNotNull(), F.substring(text, F.col("value_index") + 1, F.lit(1))).otherwise(text)
    filled = first.where(F.coalesce("value", F.lit("")) != "")
    return filled.select("record_id", "rule_id", "table", "row", "column", "operation", "marker", "replacement", F.when(~short, one).alias("value"), F.when(short, "VALUE_TOO_SHORT").alias("error"))


def records_without_rules(records: DataFrame, assignments: DataFrame) -> DataFrame:
    """Records of which no rule took a value."""
    return records.select("record_id").distinct().join(assignments.select("record_id"), "record_id", "left_anti")


def apply_assignments(assignments: DataFrame, cells: DataFrame) -> DataFrame:
    """(record_id, rule_id, text, changed, error) of the cells (table, row, column, text) after their assignments."""
    placed = assignments.where("error is null").join(cells, ["table", "row", "column"])
    done = apply_cell_op(F.col("operation"), F.col("text"), F.col("value"), F.col("marker"), F.col("replacement"))
    return placed.select("record_id", "rule_id", done.alias("d")).select("record_id", "rule_id", "d.*")


def map_template_fields(slots: DataFrame, mapping: DataFrame) -> DataFrame:
    """(case_id, template_id, field, value): the first source, by priority, that is not empty; a template's own field of a slot's name takes that slot; fields that mirror another take its value.

    Slots are (case_id, key, value); the mapping has template_id, field, priority, source (slot name), constant and mirror_of.
    """
    held = slots.where(F.coalesce("value", F.lit("")) != "").select("case_id", F.col("key").alias("source"), "value")
    cases = slots.select("case_id").distinct()
    direct = mapping.where("mirror_of is null and constant is null").join(held, "source").select("case_id", "template_id", "field", "priority", "value")
    # a constant stands in every case: all constants travel as one array, so that no rows are paired
    rule = F.struct("template_id", "field", "priority", F.col("constant").alias("value"))
    constants = mapping.where("constant is not null").agg(F.collect_list(rule).alias("c"))
    fixed = cases.select("case_id", F.explode(constants.scalar()).alias("c")).select("case_id", "c.*")
    own = mapping.select("template_id", "field").distinct().join(held.withColumnRenamed("source", "field"), "field").select("case_id", "template_id", "field", F.lit(2**31 - 1).alias("priority"), "value")
    best = direct.unionByName(fixed).unionByName(own).groupBy("case_id", "template_id", "field").agg(F.min_by("value", "priority").alias("value"))
    mirrors = mapping.where("mirror_of is not null").select("template_id", F.col("field").alias("to"), F.col("mirror_of").alias("field"))
    copies = mirrors.join(best, ["template_id", "field"]).select("case_id", "template_id", F.col("to").alias("field"), "value")
    return best.unionByName(copies.join(best, ["case_id", "template_id", "field"], "left_anti"))


def _of_document(cells: DataFrame, rows: DataFrame, fields: list[str]) -> DataFrame:
    """The cells of documents that have ``rows`` (doc_id, label and ``fields``), with ``hits``: the distinct fields of those whose label has the letters of the cell's text in one script.

    A document's rows travel as one array, so that its cells are shuffled once, by document; what follows by document, table, row or place finds them there.
    """
    asked = rows.select("doc_id", F.struct(*fields).alias("f"), label_key(F.col("label")).alias("w")).groupBy("doc_id").agg(F.collect_set(F.struct("f", "w")).alias("asked"))
    met = cells.join(asked.hint("merge"), "doc_id").withColumn("k", label_key(F.col("text")))
    same = lambda x: F.array_join(F.array(*[F.when((F.col(f"k.{part}") != "") & (F.col(f"k.{part}") == x["w"][part]), "1") for part in ("hangul", "latin")]), "") != ""
    return met.withColumn("hits", F.array_distinct(F.transform(F.filter("asked", same), lambda x: x["f"]))).drop("asked", "k")


def fill_by_label(cells: DataFrame, values: DataFrame, *, below: list[str]) -> DataFrame:
    """(doc_id, table_id, row, column, key, value): the cell that takes a value: the next to the right of the label's cell, or the one below for the keys of ``below``.

    Labels match by their letters in one script. ``values`` has doc_id, key, label and value; a place holds one cell.
    """
    place = ["doc_id", "table_id", "row", "column"]
    met = _of_document(cells.select(*place, "text"), values, ["key", "value"])
    right = F.lead("column").over(Window.partitionBy("doc_id", "table_id", "row").orderBy("column"))
    lower = F.max("row").over(Window.partitionBy("doc_id", "table_id", "column").orderBy("row").rangeBetween(1, 1))
    under = F.col("h.key").isin(*below)
    found = met.select(*place, "hits", right.alias("right"), lower.alias("lower")).where("size(hits) > 0").select(*place, "right", "lower", F.explode("hits").alias("h"))
    found = found.where(F.when(under, F.col("lower")).otherwise(F.col("right")).isNotNull())
    return found.select("doc_id", "table_id", F.when(under, F.col("lower")).otherwise(F.col("row")).alias("row"), F.when(under, F.col("column")).otherwise(F.col("right")).alias("column"), "h.key", "h.value")


def mark_options(cells: DataFrame, options: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, column, text): cells whose label is an option's, with their first empty box ticked. Options have doc_id and label."""
    place = ["doc_id", "table_id", "row", "column"]
    bare = F.regexp_replace("text", r"\[\s*\]|□", "")
    keyed = cells.where(F.col("text").rlike(r"\[\s*\]|□")).select(*place, "text", label_key(bare).alias("k"))
    wanted = options.select("doc_id", label_key(F.col("label")).alias("w")).distinct()
    by = lambda part: keyed.where(F.col(f"k.{part}") != "").withColumn("m", F.col(f"k.{part}")).join(wanted.withColumn("m", F.col(f"w.{part}")), ["doc_id", "m"], "left_semi").select(*place, "text")
    ticked = by("hangul").unionByName(by("latin")).distinct()
    box = F.regexp_extract("text", r"\[\s*\]|□", 0)
    at = F.call_function("locate", box, F.col("text"))
    return ticked.select(*place, F.concat(F.substring(F.col("text"), F.lit(1), at - 1), F.lit("[V]"), F.substring(F.col("text"), at + F.length(box), F.length("text"))).alias("text"))


#: Boxes that are empty, and the placeholder that a text value of an option rewrites.
EMPTY_BOX, STATUS = r"\[ {1,2}\]", "희망 자격"


def apply_application_options(cells: DataFrame, options: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, column, text): the cells that options change. Options have doc_id, label and value (text or null).

    An option's label finds cells by its letters; the first of them, by place, that can be marked is marked: its empty boxes are ticked, and a value also rewrites the desired status in the
    first cell that names one, from the option's own cell on in its row. Options are applied to the cells as they are; of several that rewrite one status the last by label stands. Repeated
    options count once; a null label finds nothing. A place holds one cell.
    """
    place = ["doc_id", "table_id", "row", "column"]
    met = _of_document(cells.select(*place, "text"), options, ["label", "value"])
    # the first status from a cell on in its row
    status = F.min(F.when(F.contains("text", F.lit(STATUS)), F.struct("column", "text"))).over(Window.partitionBy("doc_id", "table_id", "row").orderBy(F.desc("column")))
    found = met.withColumn("status", status).where("size(hits) > 0").select(*place, "text", "status", F.explode("hits").alias("h")).select(*place, "text", "status", "h.*")
    both = found.withColumn("boxed", F.col("text").rlike(EMPTY_BOX)).withColumn("status", F.when(F.col("value") != "", F.col("status"))).where("boxed or status is not null")
    first = both.withColumn("rn", F.row_number().over(Window.partitionBy("doc_id", "label", "value").orderBy("table_id", "row", "column"))).where("rn = 1")
    edit = lambda column, text, label, value: F.struct(column.alias("column"), text.alias("text"), label.alias("label"), value.alias("value"))
    none = F.lit(None).cast("string")
    tick, rewrite = F.when(F.col("boxed"), edit(F.col("column"), F.col("text"), none, none)), F.when(F.col("status").isNotNull(), edit(F.col("status.column"), F.col("status.text"), F.col("label"), F.col("value")))
    edits = first.select("doc_id", "table_id", "row", F.explode(F.array_compact(F.array(tick, rewrite))).alias("e")).select("doc_id", "table_id", "row", "e.*")
    edits = edits.groupBy(*place).agg(F.first("text").alias("text"), F.count_if(F.col("label").isNull()).alias("ticks"), F.max_by("value", "label").alias("value"))
    ticked = F.when(F.col("ticks") > 0, F.regexp_replace("text", EMPTY_BOX, "[v]")).otherwise(F.col("text"))
    quoted = F.regexp_replace("value", r"([\\$])", r"\\$1")
    done = F.when(F.col("value").isNull(), ticked).otherwise(F.regexp_replace(ticked, F.lit(r"(?U)희망\s*자격\s*:\s*[^)]*"), F.concat(F.lit(f"{STATUS} : "), quoted)))
    return edits.select(*place, done.alias("text"))
