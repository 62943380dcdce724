"""Forms and audits: cells, adjacent labels, document differences, plans and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.fields import known_label


def label_blank_pairs(cells: DataFrame) -> DataFrame:
    """Labels whose next cell in the row is blank; labels are not empty, don't start with a filled square and have at most 100 characters."""
    order = Window.partitionBy("doc_id", "table_id", "row").orderBy("column")
    rows = cells.withColumns({"next_text": F.lead("text").over(order), "next_column": F.lead("column").over(order)})
    label = F.trim("text")
    return rows.where((label != "") & ~label.startswith("■") & (F.length(label) <= 100) & (F.trim("next_text") == "")).select("doc_id", "table_id", "row", label.alias("label"), F.col("column").alias("label_column"), F.col("next_column").alias("column"))


def character_grids(cells: DataFrame, *, least: int = 4) -> DataFrame:
    """Runs of at least four blank cells after a label: one field with the number of its slots."""
    row = Window.partitionBy("doc_id", "table_id", "row").orderBy("column")
    blank = F.trim("text") == ""
    marked = cells.withColumns({"blank": blank, "island": F.row_number().over(row) - F.sum(F.when(blank, 1).otherwise(0)).over(row), "label": F.last(F.when(~blank, F.trim("text")), ignorenulls=True).over(row)})
    runs = marked.where("blank").groupBy("doc_id", "table_id", "row", "island").agg(F.count("*").alias("slots"), F.min("column").alias("column"), F.first("label").alias("label"))
    return runs.where((F.col("slots") >= least) & F.col("label").isNotNull() & ~F.col("label").startswith("■")).drop("island")


def diff_cells(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc_id, item_id, change, old, new) of added, removed and changed items; null texts count as empty."""
    old, new = before.select("doc_id", "item_id", F.col("text").alias("o"), F.lit(True).alias("had")), after.select("doc_id", "item_id", F.col("text").alias("n"), F.lit(True).alias("has"))
    both = old.join(new, ["doc_id", "item_id"], "full_outer")
    change = F.when(F.col("had").isNull(), "added").when(F.col("has").isNull(), "removed").when(F.coalesce("o", F.lit("")) != F.coalesce("n", F.lit("")), "changed")
    return both.withColumn("change", change).where("change is not null").select("doc_id", "item_id", "change", F.coalesce("o", F.lit("")).alias("old"), F.coalesce("n", F.lit("")).alias("new"))


def check_expected_changes(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, item_id, problem): changes nobody expected, and expected ones that did not happen."""
    keys = ["doc_id", "item_id"]
    extra = actual.join(expected, keys, "left_anti").select(*keys, F.lit("unexpected").alias("problem"))
    return extra.unionByName(expected.join(actual, keys, "left_anti").select(*keys, F.lit("missing").alias("problem")))


def manifest_counts(items: DataFrame) -> DataFrame:
    """Paragraphs, tables and images of each document."""
    return items.groupBy("doc_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}s") for k in ("paragraph", "table", "image")])


def same_shape(before: DataFrame, after: DataFrame) -> DataFrame:
    """The counts of ``before`` with same_shape: whether ``after`` has the same of every kind; a document that is not in both has not."""
    kinds = [c for c in before.columns if c != "doc_id"]
    other = after.select("doc_id", *[F.col(c).alias(f"after_{c}") for c in kinds])
    same = F.lit(True)
    for c in kinds:
        same = same & (F.col(c) == F.col(f"after_{c}"))
    return before.join(other, "doc_id", "left").select("doc_id", *kinds, F.coalesce(same, F.lit(False)).alias("same_shape"))


def known_label_cells(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, column, label): cells that hold a known label and are in no label-and-blank pair."""
    pairs = label_blank_pairs(cells)
    used = pairs.select("doc_id", "table_id", "row", F.explode(F.array("column", "label_column")).alias("column")).distinct()
    rows = cells.withColumn("label", known_label(F.trim("text"))).where("label is not null")
    return rows.join(used, ["doc_id", "table_id", "row", "column"], "left_anti").select("doc_id", "table_id", "row", "column", "label")


def current_plan(plans: DataFrame) -> DataFrame:
    """Adds is_current and superseded_at: the newest plan of a document stands, an older one ends when the next is made."""
    order = Window.partitionBy("doc_id").orderBy("created_at", "plan_id")
    return plans.withColumn("superseded_at", F.lead("created_at").over(order)).withColumn("is_current", F.lead("plan_id").over(order).isNull())


def attempt_sequence(attempts: DataFrame, *, cap: int = 2) -> DataFrame:
    """Adds sequence, counted and needs_human: attempts that gave output count, and from the third on a person decides."""
    order = Window.partitionBy("doc_id").orderBy("started_at", "attempt_id")
    counted = F.sum(F.when(F.col("result") != "ABORTED_NO_OUTPUT", 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return attempts.withColumns({"sequence": F.row_number().over(order), "counted": counted}).withColumn("needs_human", F.col("counted") > cap)


def rollup_verdict(verdicts: DataFrame) -> DataFrame:
    """FAIL if any field fails, else NEEDS_HUMAN if any needs one, else PASS."""
    worst = F.max(F.when(F.col("verdict") == "FAIL", 2).when(F.col("verdict") == "NEEDS_HUMAN", 1).otherwise(0))
    return verdicts.groupBy("doc_id").agg(worst.alias("w")).select("doc_id", F.element_at(F.array(F.lit("PASS"), F.lit("NEEDS_HUMAN"), F.lit("FAIL")), F.col("w") + 1).alias("verdict"))


def best_ocr_field(fields: DataFrame) -> DataFrame:
    """Of fields with one name the one of highest confidence, ties to the later one."""
    return fields.groupBy("doc_id", "name").agg(F.max_by(F.struct("text", "confidence"), F.struct("confidence", "pos")).alias("b")).select("doc_id", "name", "b.text", "b.confidence")
