"""Finding a form's fields in its cells: inputs inside a cell's text, the union of all passes, typed edits of cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.functions.facts import let, located
from caseflow.functions.fields import any_word, is_required, row_category
from caseflow.functions.text import strip
from caseflow.operators import regions

#: What inputs inside a cell's text look like.
INLINE_DATE = r"(?U)(?:\d{4}\s*)?년\s+(?:\d{1,2}\s*)?월\s+(?:\d{1,2}\s*)?일"
SIGNABLE = r"(?iU)\(서명\s*또는\s*인\)|서명\s*또는\s*인|\((?:signature|seal)\)|\(날인\)"
AMOUNT = r"(?iU)\(\s{3,}\)\s*(?:원|won)"
PLACEHOLDER = r"(?U)[(（]([^)）]+?)\s*:\s*?(\s{4,})[)）]"
BOX = r"(?U)\[\s*\]"
SEGMENT_DATE = r"(?U)(년\s*월\s*일|년\s+\d*월\s+\d*일|\d{4}\.\s*\d{1,2}\.\s*\d{1,2})"
SEGMENT_BOX = r"(?U)(\[\s*\]|\[\s*V\s*\]|\[\s*■\s*\]|□)"
SEGMENT_SIGN = r"(?U)(\(서명\s*또는\s*인\)|\(인\)|\(서명\)|\(날인\))"
#: What stands in every input inside a text; cheap to look for.
INLINE_MARKS = ["년", "서명", "(", "（", "["]
NUMBER_WORDS = ["사업자등록번호", "주민등록번호", "Identification number"]
PLACE = ["doc_id", "table_id", "row", "column"]
#: Order of the passes: an earlier one keeps a cell that it claims.
PASSES = ["character_grid", "date_segments", "amount_unit", "date_inline", "signable", "amount", "checkbox_group", "checkbox", "placeholder", "blank"]
CLAIMS = ["character_grid", "date_segments", "amount_unit", "checkbox_group", "checkbox", "placeholder", "blank"]


def unique_anchor(text: Column, start: Column, stop: Column) -> Column:
    """The text around a span, widened from 16 letters on each side by doubling, until it stands in the text once or is the whole text. Places count from 0, the stop exclusive.

    The steps are as many as the text's length needs to reach both its ends; after the first part that stands once no other is searched for.
    """

    def around(k: Column) -> Column:
        pad = F.lit(16) * F.pow(F.lit(2), k).cast("long")
        first = F.greatest(F.lit(0).cast("long"), start - pad)
        return F.substring(text, (first + 1).cast("int"), (F.least(F.length(text).cast("long"), stop + pad) - first).cast("int"))

    once = lambda part: (F.length(text) - F.length(F.replace(text, part, F.lit("")))) == F.length(part)
    steps = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.log2(F.length(text) / 16 + 1)).cast("int")))
    widen = lambda found, k: F.when(found.isNotNull(), found).otherwise(let(around(k), lambda part: F.when(once(part), part)))
    return F.coalesce(F.aggregate(steps, F.lit(None).cast("string"), widen), text)


def segment_fields(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, column, kind, at, anchor): numbers, the first date, each box and a signature inside a cell's text."""
    text = F.col("text")
    box = F.transform(located(text, SEGMENT_BOX), lambda m: F.struct(F.lit("checkbox").alias("kind"), m["start"].alias("at"), m["value"].alias("anchor")))
    one = lambda rule, kind, anchor: F.when(rule, F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("at"), anchor.alias("anchor")))).otherwise(F.array().cast("array<struct<kind:string,at:int,anchor:string>>"))
    found = F.concat(
        one(any_word(text, NUMBER_WORDS), "number", F.lit("사업자등록번호")), one(text.rlike(SEGMENT_DATE), "date", F.regexp_extract(text, SEGMENT_DATE, 0)), box, one(text.rlike(SEGMENT_SIGN), "signature", F.regexp_extract(text, SEGMENT_SIGN, 0))
    )
    return cells.select(*PLACE, F.explode(found).alias("s")).select(*PLACE, "s.*")


def inline_spots(text: Column) -> Column:
    """Dates, signatures and amounts inside a text, boxes with their labels, placeholders: an array of (kind, at, label)."""
    spot = lambda pattern, kind, label: F.transform(located(text, pattern), lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("at"), (F.lit(label) if label else m["value"]).alias("label")))
    named = lambda part, pattern: F.filter(F.transform(F.regexp_extract_all(part, F.lit(pattern), F.lit(1)), lambda x: strip(F.regexp_replace(strip(x), "^,+|,+$", ""))), lambda x: x != "")
    # no label stands before a box that is not there: what follows the last bracket is not searched
    upto = F.substring(text, F.lit(1), F.length(text) - F.length(F.substring_index(text, "]", -1)))
    sides = F.struct(named(upto, r"(?U)([가-힣A-Za-z][^\[\]]*?)\s*\[\s*\]").alias("before"), named(text, r"(?U)\[\s*\]\s*([가-힣A-Za-z][^\[\]]*)").alias("after"))
    chosen = let(sides, lambda s: F.when((F.size(s["before"]) >= F.size(s["after"])) | (F.size(s["after"]) == 0), s["before"]).otherwise(s["after"]))
    bare = F.substring(strip(F.regexp_replace(text, BOX, "")), 1, 60)
    none = F.array().cast("array<struct<kind:string,at:int,label:string>>")
    one = lambda kind, label: F.array(F.struct(F.lit(kind).alias("kind"), F.lit(0).alias("at"), label.alias("label")))
    of_labels = lambda x: F.when(F.size(x) > 1, one("checkbox_group", F.array_join(F.slice(x, 1, 4), " / "))).when(F.size(x) == 1, one("checkbox", F.try_element_at(x, F.lit(1)))).when(bare != "", one("checkbox", bare)).otherwise(none)
    boxes = F.when(text.rlike(BOX), let(chosen, of_labels)).otherwise(none)
    blank = F.when(text.rlike(PLACEHOLDER), one("placeholder", strip(F.regexp_extract(text, PLACEHOLDER, 1)))).otherwise(none)
    every = F.concat(spot(INLINE_DATE, "date_inline", "날짜 입력 영역"), spot(SIGNABLE, "signable", None), spot(AMOUNT, "amount", "금액 입력 영역"), boxes, blank)
    return F.when(any_word(text, INLINE_MARKS), every).otherwise(none)


def inline_fields(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, column, kind, at, label) of what stands inside a cell's text."""
    return cells.select(*PLACE, F.explode(inline_spots(F.col("text"))).alias("s")).select(*PLACE, "s.*")


def field_union(cells: DataFrame) -> DataFrame:
    """(doc_id, table_id, row, column, at, kind, label, category, required): all passes over the cells before a table's official part, in their order; of the passes that claim a
    whole cell the first one keeps it, the others (dates, signatures and amounts inside a text) add to it."""
    table, row = Window.partitionBy("doc_id", "table_id"), Window.partitionBy(*regions.ROW)
    order = row.orderBy("column")
    text, trimmed, stripped, column = F.col("text"), F.trim("text"), strip(F.col("text")), F.col("column")
    # cells meet once, in the order of their tables; all passes are windows over that order
    rows = cells.select(*PLACE, "text").repartition("doc_id").sortWithinPartitions(*PLACE)
    rows = rows.withColumn("start_row", F.min(F.when(any_word(text, regions.OFFICIAL_WORDS), F.col("row"))).over(table)).where("start_row is null or row < start_row")
    anchors = {a: F.min(F.when(F.contains(F.lower("text"), F.lit(a)), column)).over(row) for a in regions.DATE_ANCHORS}
    rows = rows.withColumns(
        {
            **anchors,
            "blank": trimmed == "",
            "next_text": F.lead("text").over(order),
            "next_column": F.lead("column").over(order),
            "island": F.row_number().over(order) - F.sum(F.when(trimmed == "", 1).otherwise(0)).over(order),
            "grid_label": F.last(F.when(trimmed != "", trimmed), ignorenulls=True).over(order),
            "left_label": F.last(F.when(stripped != "", stripped), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        }
    )
    dated = F.col("yyyy").isNotNull() & F.col("mm").isNotNull() & F.col("dd").isNotNull()
    before_year = F.min_by(stripped, F.when((column < F.col("yyyy")) & (stripped != ""), column)).over(row)
    run = Window.partitionBy(*regions.ROW, "island", "blank")
    rows = rows.withColumns({"date_label": F.coalesce(before_year, F.lit("날짜")), "slots": F.count("*").over(run), "first": F.min("column").over(run)})
    grid = F.coalesce(F.col("blank") & (column == F.col("first")) & (F.col("slots") >= 4) & ~F.col("grid_label").startswith("■"), F.lit(False))
    # columns that a grid or a split date takes
    span = F.struct(column.alias("start"), (column + F.col("slots").cast("int") - 1).alias("stop"))
    rows = rows.withColumn("grids", F.collect_list(F.when(grid, span)).over(row)).withColumn("dates", F.when(dated, F.array(*regions.DATE_ANCHORS)))
    one = lambda rule, at, kind, label: F.when(rule, F.array(F.struct(at.alias("column"), F.lit(0).alias("at"), F.lit(kind).alias("kind"), label.alias("label"))))
    beside = (trimmed != "") & ~trimmed.startswith("■") & (F.length(trimmed) <= 100) & (F.trim("next_text") == "")
    inline = F.transform(inline_spots(text), lambda s: F.struct(column.alias("column"), s["at"].alias("at"), s["kind"].alias("kind"), s["label"].alias("label")))
    passes = [
        one(grid, column, "character_grid", F.col("grid_label")),
        one(dated & (column == F.col("yyyy")), column, "date_segments", F.col("date_label")),
        one(text.rlike(regions.AMOUNT_UNIT), column, "amount_unit", F.coalesce("left_label", F.lit("금액"))),
        inline,
        one(beside, F.col("next_column"), "blank", trimmed),
    ]
    every = rows.select(*regions.ROW, "grids", "dates", F.explode(F.flatten(F.array_compact(F.array(*passes)))).alias("f")).select(*regions.ROW, "grids", "dates", "f.*")
    by = F.when(F.exists("grids", lambda g: column.between(g["start"], g["stop"])), 0).when(F.array_contains("dates", column), 1)
    number = F.array_position(F.array(*map(F.lit, PASSES)), F.col("kind")).cast("int") - 1
    claims = F.col("kind").isin(*CLAIMS)
    ranked = every.withColumn("by", by).withColumn("pass", number).where(~claims | F.col("by").isNull() | (F.col("pass") <= F.col("by")))
    first = Window.partitionBy(*PLACE, claims).orderBy("pass", "at")
    kept = ranked.withColumn("rn", F.row_number().over(first)).where(~claims | (F.col("rn") == 1))
    return kept.select(*PLACE, "at", "kind", F.substring("label", 1, 60).alias("label"), row_category(F.col("row")).alias("category"), is_required(F.col("label")).alias("required"))


def apply_typed_op(edits: DataFrame) -> DataFrame:
    """Adds texts (array) and error to (operation, new_value, texts_before (array), anchor, token, mode, anchors, separators, expected_count): a form's cells after one typed edit.

    Grids take one letter a cell, dates one or three cells, boxes a mark for their anchor, amounts stand before their unit or in its brackets, other edits replace an anchor that stands
    as often as expected. An error leaves the cells as they are.
    """
    before, value = F.col("texts_before"), F.coalesce("new_value", F.lit(""))
    first, anchor = F.coalesce(F.try_element_at(before, F.lit(1)), F.lit("")), F.coalesce("anchor", F.lit(""))
    times = lambda text, part: F.when(part != "", ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("int")).otherwise(0)
    swap = lambda text, part, by: F.concat(F.substring(text, F.lit(1), F.call_function("locate", part, text) - 1), by, F.substring(text, F.call_function("locate", part, text) + F.length(part), F.length(text)))
    letters = F.filter(F.split(value, ""), lambda c: (c != "") & ~F.array_contains(F.coalesce("separators", F.array().cast("array<string>")), c))
    pattern = r"^(\d{4})[-./](\d{1,2})[-./](\d{1,2})$"
    part = lambda i: F.regexp_extract(value, pattern, i)
    korean = F.concat(part(1), F.lit("년 "), part(2), F.lit("월 "), part(3), F.lit("일"))
    token = F.coalesce("token", F.col("anchor"), F.lit(""))
    dated = F.replace(first, anchor, swap(anchor, token, korean))
    marks = F.coalesce("anchors", F.array(F.lit("yyyy"), F.lit("mm"), F.lit("dd")))
    three = F.transform(F.arrays_zip(before.alias("t"), marks.alias("a"), F.array(part(1), part(2), part(3)).alias("v")), lambda x: F.replace(x["t"], x["a"], x["v"]))
    op, n, count = F.col("operation"), F.size(before), F.coalesce("expected_count", F.lit(1))
    fits = F.exists(F.arrays_zip(before.alias("t"), marks.alias("a")), lambda x: ((F.length(x["t"]) - F.length(F.replace(x["t"], x["a"], F.lit("")))) / F.length(x["a"])) != 1)
    prefixed = F.replace(first, anchor, F.concat(value, F.lit(" "), anchor))
    bracket = swap(anchor, token, F.regexp_replace(token, r"\(\s+\)", F.concat(F.lit("("), value, F.lit(")"))))
    placed = F.when(F.col("token").isNotNull(), swap(anchor, token, F.concat(F.lit(" "), value))).otherwise(value)
    grid, date, box, amount, text = op == "write_character_grid", op == "set_date_segments", op == "set_checkbox", op == "set_amount", op.isin("set_amount", "replace_text_range")
    anchored = times(first, anchor) != count
    error = (
        F.when((value == "") | (F.length(value) > 10000), "VALUE_LENGTH")
        .when(grid & (F.size(letters) != n), "GRID_LENGTH")
        .when(grid & F.exists(before, lambda t: t != ""), "GRID_NOT_EMPTY")
        .when(date & ~value.rlike(pattern), "DATE_FORM")
        .when(date & ~n.isin(1, 3), "DATE_SEGMENTS")
        .when(date & (n == 1) & ~F.coalesce(F.col("mode").isin("empty_cell", "inline"), F.lit(False)), "DATE_MODE")
        .when(date & (n == 1) & (F.col("mode") == "empty_cell") & (first != ""), "CELL_NOT_EMPTY")
        .when(date & (n == 1) & (F.col("mode") == "inline") & (times(first, anchor) != 1), "ANCHOR_COUNT")
        .when(date & (n == 3) & (F.coalesce("mode", F.lit("")) != "empty_cells") & fits, "ANCHOR_COUNT")
        .when(box & (times(first, anchor) != 1), "ANCHOR_COUNT")
        .when(op == "set_signature_placeholder", "SIGNATURE_IS_MANUAL")
        .when(~(grid | date | box | text), "UNSUPPORTED_OPERATION")
        .when(text & (anchor != "") & anchored, "ANCHOR_COUNT")
        .when(text & (anchor == "") & (first != ""), "ANCHOR_REQUIRED")
    )
    after = (
        F.when(grid, letters)
        .when(date & (n == 1), F.array(F.when(F.col("mode") == "empty_cell", value).otherwise(dated)))
        .when(date, F.when(F.col("mode") == "empty_cells", F.array(part(1), part(2), part(3))).otherwise(three))
        .when(box, F.array(F.replace(first, anchor, F.lit("[V]"))))
        .when(anchor == "", F.array(value))
        .when(amount & (F.col("mode") == "prefix_unit"), F.array(prefixed))
        .when(amount, F.array(F.replace(first, anchor, bracket)))
        .otherwise(F.array(F.replace(first, anchor, placed)))
    )
    return edits.withColumn("error", error).withColumn("texts", F.when(F.col("error").isNull(), after).otherwise(before))
