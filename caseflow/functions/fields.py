"""Column functions of form fields: dates, phone numbers, boxes, cell operations, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.facts import let, parse_date
from caseflow.functions.text import strip

#: Words for a ticked and an unticked box, and for true and false.
TICKED = ["V", "[V]", "■", "[■]", "TRUE", "YES", "예", "선택", "남", "남성", "여", "여성", "CHECKED"]
UNTICKED = ["FALSE", "NO", "아니오", "미선택", "UNCHECKED", "[ ]", "□"]
TRUE_WORDS, FALSE_WORDS = ["1", "true", "yes", "y", "on", "checked"], ["0", "false", "no", "n", "off", "unchecked"]
#: Keywords of field types, in order.
TYPE_WORDS = [
    ("phone", ["전화", "phone", "cell phone", "telephone"]), ("date", ["날짜", "일자", "date", "기간", "유효", "생년월일"]), ("signature", ["서명", "signature", "seal", "날인"]),
    ("amount", ["소득", "금액", "만원", "amount", "income"]), ("number", ["번호", "등록번호", "no."]),
]
OPTIONAL_WORDS = ["해당자", "소지자", "해당 시", "에만 기재", "에 한함"]
KNOWN_LABELS = ["업체명", "전화번호", "소재지", "생년월일", "본국주소", "성명"]
KINDS = {"checkbox_group": "checkbox_group", "checkbox": "checkbox", "placeholder": "placeholder", "date": "date_segments", "signature": "signable_region"}
#: Month names of bilingual dates.
MONTHS = ["JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC"]


def any_word(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | F.contains(text, F.lit(w))
    return found


def normalize_form_date(c: Column) -> Column:
    """``Y년 M월 D일`` from a Korean or year-month-day date; null if it is none or no day."""
    pattern = r"(?U)^\s*(\d{4})\s*(?:년|[./-])\s*(\d{1,2})\s*(?:월|[./-])\s*(\d{1,2})\s*일?\s*$"
    parts = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    number = lambda p: p.cast("int").cast("string")
    text = F.concat(number(parts[0]), F.lit("년 "), number(parts[1]), F.lit("월 "), number(parts[2]), F.lit("일"))
    return F.when(c.rlike(pattern), F.when(parse_date(*parts).isNotNull(), text))


def normalize_form_phone(c: Column) -> Column:
    """02 and 10- or 11-digit numbers with hyphens; +82 and 0082 become 0. Null for all else."""
    compact = F.regexp_replace(c, "[^0-9+]", "")
    compact = F.when(compact.startswith("+82"), F.concat(F.lit("0"), F.substring(compact, 4, 99))).when(compact.startswith("0082"), F.concat(F.lit("0"), F.substring(compact, 5, 99))).otherwise(compact)
    n = F.length(compact)
    cut = lambda *sizes: F.concat_ws("-", *[F.substring(compact, sum(sizes[:i]) + 1, s) for i, s in enumerate(sizes)])
    seoul = compact.startswith("02")
    shaped = F.when(seoul & (n == 9), cut(2, 3, 4)).when(seoul & (n == 10), cut(2, 4, 4)).when(n == 10, cut(3, 3, 4)).when(n == 11, cut(3, 4, 4))
    return F.when(compact.rlike("^[0-9]+$"), shaped)


def normalize_form_checkbox(c: Column, *, strict: bool = False) -> Column:
    """``[V]`` or ``[ ]``; other text counts as ticked, or is null where ``strict``."""
    word = F.upper(strip(c))
    return F.when(word.isin(*TICKED), "[V]").when(word.isin(*UNTICKED), "[ ]").otherwise(F.lit(None) if strict else F.lit("[V]"))


def parse_boolean(c: Column) -> Column:
    """True and false words; null for all else."""
    word = F.lower(strip(c))
    return F.when(word.isin(*TRUE_WORDS), True).when(word.isin(*FALSE_WORDS), False)


def parse_document_date(c: Column, *, day_first: bool = False) -> Column:
    """A document's date: year first with - . or /; with ``day_first`` also day-month-year in four notations; and bilingual dates whose two months agree."""
    return let(strip(c), lambda text: _document_date(text, day_first))


def _document_date(text: Column, day_first: bool) -> Column:
    """Dates by their shape: the pattern that fits the whole text gives the parts, all at once."""

    def dated(pattern: str, year: int, month, day: int, *, if_=None) -> tuple[Column, Column]:
        parts = F.split(F.regexp_replace(text, pattern, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")
        made = let(parts, lambda p: F.when(if_(p) if if_ else F.lit(True), parse_date(p[year - 1], month(p), p[day - 1])))
        return text.rlike(pattern), made

    nth = lambda i: lambda p: p[i - 1]
    month_of = lambda name: F.array_position(F.array(*map(F.lit, MONTHS)), F.upper(name)).cast("string")
    shapes = [dated(r"^(\d{4})([-./])(\d{1,2})\2(\d{1,2})$", 1, nth(3), 4)]
    if day_first:
        shapes.append(dated(r"^(\d{1,2})([-./])(\d{1,2})\2(\d{4})$", 4, nth(3), 1))
        shapes.append(dated(r"(?U)^(\d{1,2})(\s+)([A-Za-z]{3})\s+(\d{4})$", 4, lambda p: month_of(p[2]), 1))
    agree = lambda p: month_of(p[2]) == p[1].cast("int").cast("string")
    shapes.append(dated(r"(?U)^(\d{1,2})\s+(\d{1,2})월\s*/\s*([A-Za-z]{3})\s+(\d{4})$", 4, nth(2), 1, if_=agree))
    out = None
    for fits, made in shapes:
        out = F.when(fits, made) if out is None else out.when(fits, made)
    return out


def mrz_birth_date(c: Column, as_of: Column) -> Column:
    """The birth date behind the country code VNM in a machine-readable zone: years after ``as_of`` belong to the century before; a date after ``as_of`` is null."""
    digits = F.regexp_extract(F.upper(F.regexp_replace(c, r"(?U)\s+", "")), r"VNM(\d{6})", 1)
    year = F.lit(2000) + F.substring(digits, 1, 2).cast("int")
    year = F.when(year > F.year(as_of), year - 100).otherwise(year)
    day = F.when(digits != "", parse_date(year.cast("string"), F.substring(digits, 3, 2), F.substring(digits, 5, 2)))
    return F.when(day <= as_of, day)


def birth_parts(c: Column) -> Column:
    """(year, month, day) of the first date-like text, month and day in two digits; null if there is none."""
    pattern = r"(\d{4})\D+(\d{1,2})\D+(\d{1,2})"
    part = lambda i: F.regexp_extract(c, pattern, i)
    return F.when(c.rlike(pattern), F.struct(part(1).alias("year"), F.lpad(part(2), 2, "0").alias("month"), F.lpad(part(3), 2, "0").alias("day")))


def field_type(label: Column) -> Column:
    """The type a label suggests, by the first keyword that fits; passport numbers are text."""
    low = F.lower(label)
    found = F.when(any_word(low, ["여권", "passport"]) & any_word(low, ["번호", "number", "no."]), "text")
    for kind, words in TYPE_WORDS:
        found = found.when(any_word(low, words), kind)
    return found.otherwise("text")


def field_kind(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, v) for k, v in KINDS.items()], F.lit("text_field"))


def row_category(row: Column) -> Column:
    return F.when(row <= 12, "step1_application").when(row <= 18, "step2_personal").when(row <= 27, "step3_address").otherwise("step4_signature")


def is_required(text: Column) -> Column:
    return ~any_word(text, OPTIONAL_WORDS)


def known_label(text: Column) -> Column:
    """The first known label that a text holds; texts that start with a filled square have none."""
    return F.when(~text.startswith("■"), F.coalesce(*[F.when(F.contains(text, F.lit(w)), w) for w in KNOWN_LABELS]))


def label_key(c: Column) -> Column:
    """(hangul, latin): the letters of a label by script, latin ones small."""
    return F.struct(F.regexp_replace(c, "[^가-힣]", "").alias("hangul"), F.lower(F.regexp_replace(c, "[^a-zA-Z]", "")).alias("latin"))


def label_matches(a: Column, b: Column) -> Column:
    """Whether two labels have the same letters in one script."""
    x, y = label_key(a), label_key(b)
    return ((x["hangul"] != "") & (x["hangul"] == y["hangul"])) | ((x["latin"] != "") & (x["latin"] == y["latin"]))


def bulk_replace(text: Column, old: Column, new: Column) -> Column:
    """(text, replaced, error): every ``old`` becomes ``new``; none is an error."""
    times = F.when(old != "", (F.length(text) - F.length(F.replace(text, old, F.lit("")))) / F.length(old)).otherwise(0).cast("int")
    return F.struct(F.replace(text, old, new).alias("text"), times.alias("replaced"), F.when(times == 0, "NOTHING_REPLACED").alias("error"))


def apply_cell_op(operation: Column, current: Column, value: Column, marker: Column, replacement: Column) -> Column:
    """(text, changed, error) of a cell after one operation: set, append, prepend, prepend_line, replace (the first marker), checkbox (the same if the value is true)."""
    now, ticked = F.coalesce(current, F.lit("")), parse_boolean(value)
    gap = F.when((now == "") | now.rlike("[ \t\n]$"), "").otherwise("  ")
    filled = F.replace(replacement, F.lit("{value}"), value)
    at = F.call_function("locate", marker, now)
    swapped = F.concat(F.substring(now, F.lit(1), at - 1), filled, F.substring(now, at + F.length(marker), F.length(now)))
    swaps = operation.isin("replace", "checkbox")
    asked = (operation == "replace") | ticked
    error = (
        F.when(~operation.isin("set", "append", "prepend", "prepend_line", "replace", "checkbox"), "UNSUPPORTED_OPERATION")
        .when((operation == "checkbox") & ticked.isNull(), "NOT_A_BOOLEAN")
        .when(swaps & asked & ((F.coalesce(marker, F.lit("")) == "") | replacement.isNull()), "MARKER_REQUIRED")
        .when(swaps & asked & (at == 0), "MARKER_NOT_FOUND")
    )
    text = (
        F.when(operation == "set", value)
        .when(operation == "append", F.concat(now, gap, value))
        .when(operation == "prepend", F.concat(value, F.when((now == "") | value.endswith(" "), "").otherwise(" "), now))
        .when(operation == "prepend_line", F.concat(value, F.lit("\n"), now))
        .when(swaps & asked, swapped)
        .otherwise(now)
    )
    changed = error.isNull() & ~((operation == "checkbox") & ~F.coalesce(ticked, F.lit(False)))
    return F.struct(F.when(error.isNull(), text).otherwise(now).alias("text"), changed.alias("changed"), error.alias("error"))
