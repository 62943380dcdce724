"""Column functions on requests and replies: names in Korean instructions, English terms, aliases, JSON replies, phases and outcomes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.text import strip

#: Particles that stand alone, words that end a name, particles by whether a final consonant comes before them.
LONE_PARTICLES = ["의", "을", "를", "이", "가", "은", "는"]
STOP_WORDS = ["체류", "계약", "재계약", "서류", "급여", "연장", "준비", "요청", "등록", "변경", "안내"]
AFTER_CONSONANT, AFTER_VOWEL, ALWAYS = ["이", "은", "을"], ["가", "는", "를"], ["의"]
WEEKDAYS = {"월": "Monday", "화": "Tuesday", "수": "Wednesday", "목": "Thursday", "금": "Friday", "토": "Saturday", "일": "Sunday"}
#: A route's status, outcome and scenario.
OUTCOMES = {
    "out_of_scope": ("CANCELLED", "OUT_OF_SCOPE", "out_of_scope"), "ask_hr": ("NEEDS_INFO", "NEEDS_INFO", "ask_hr"), "ask_worker": ("WAITING_WORKER", "WAITING_WORKER", "ask_worker"),
    "ocr": ("DRAFT", "OCR_SAVED", "ocr"), "generate": ("READY_FOR_REVIEW", "REVIEW_REQUIRED", "generate"),
}


def _stripped(token: Column) -> Column:
    """(name, ended): a token without its particle, if one fits the syllable before it."""
    last, before = F.right(token, F.lit(1)), F.ascii(F.substring(token, -2, 1))
    hangul = before.between(0xAC00, 0xAC00 + 11171)
    closed = (before - 0xAC00) % 28 != 0
    fits = last.isin(*ALWAYS) | (last.isin(*AFTER_CONSONANT) & hangul & closed) | (last.isin(*AFTER_VOWEL) & hangul & ~closed)
    cut = (F.length(token) >= 2) & fits
    return F.struct(F.when(cut, F.substring(token, F.lit(1), F.length(token) - 1)).otherwise(token).alias("name"), cut.alias("ended"))


def target_name(instruction: Column) -> Column:
    """The name that leads an instruction: its words up to a lone particle, a word of work or a word with a particle, which is taken off; "unknown" if there is none."""
    text = strip(F.regexp_replace(instruction, r",\s*[A-Z][A-Z0-9_]+\s*$", ""))
    begin = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(False).alias("done"))

    def step(acc: Column, token: Column) -> Column:
        stop = token.isin(*LONE_PARTICLES)
        for word in STOP_WORDS:
            stop = stop | token.startswith(word)
        bare = _stripped(token)
        added = F.struct(F.concat(acc["parts"], F.array(bare["name"])).alias("parts"), bare["ended"].alias("done"))
        return F.when(acc["done"], acc).when(stop, F.struct(acc["parts"].alias("parts"), F.lit(True).alias("done"))).otherwise(added)

    name = F.aggregate(F.filter(F.split(text, r"(?U)\s+"), lambda t: t != ""), begin, step, lambda acc: F.array_join(acc["parts"], " "))
    return F.when(F.coalesce(name, F.lit("")) == "", "unknown").otherwise(name)


def english_working_hours(c: Column) -> Column:
    """``from (09:00) to (18:00)`` of Korean hours; other text unchanged."""
    pattern = r"(?U)(\d{1,2})시\s*(\d{1,2})분\s*~\s*(\d{1,2})시\s*(\d{1,2})분"
    p = [F.lpad(F.regexp_extract(c, pattern, i), 2, "0") for i in (1, 2, 3, 4)]
    return F.when(c.rlike(pattern), F.format_string("from (%s:%s) to (%s:%s)", *p)).otherwise(c)


def english_probation_wage(c: Column) -> Column:
    """The wage and that of the first three months, where a text names two sums; other text unchanged."""
    sums = F.transform(F.regexp_extract_all(c, F.lit(r"\d[\d,]*원"), F.lit(0)), lambda x: F.replace(x, F.lit("원"), F.lit("")))
    return F.when(F.size(sums) >= 2, F.format_string("%s won, but for up to the first 3 months of probation period: %s won", F.try_element_at(sums, F.lit(1)), F.try_element_at(sums, F.lit(2)))).otherwise(c)


def english_payment_date(c: Column) -> Column:
    """The day of the month or of the week on which wages are paid, where a text names both; other text unchanged."""
    month, week = r"매월\s*\(([^)]*)\)일", r"매주\s*\(([^)]*)\)요일"
    name = strip(F.regexp_extract(c, week, 1))
    day = F.coalesce(*[F.when(name == k, v) for k, v in WEEKDAYS.items()], name)
    text = "Every (%s)th day of the month or every (%s) day of the week. If the payment date falls on a holiday, the payment will be made on the day before the holiday."
    return F.when(c.rlike(month) & c.rlike(week), F.format_string(text, F.regexp_extract(c, month, 1), day)).otherwise(c)


def alias_coalesce(fields: Column, *names: str) -> Column:
    """The first of a map's entries by these names that is not null or empty."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(n)), F.lit("")) for n in names])


def parse_json_reply(reply: Column, schema: str) -> Column:
    """(value, error): a reply as JSON of a fixed schema, with or without a code fence around it; what is no JSON or lacks a field is an error."""
    text = strip(reply)
    fenced = text.startswith("```") & text.endswith("```") & (F.length(text) > 3)
    body = F.when(fenced, strip(F.regexp_replace(F.regexp_replace(text, r"^```[^\n]*\n?", ""), r"\n?```$", ""))).otherwise(text)
    value = F.from_json(body, schema, {"mode": "PERMISSIVE"})
    names = [part.strip().split()[0] for part in schema.split(",") if part.strip() and "<" not in part.split()[0]]
    whole = F.lit(True)
    for n in names:
        whole = whole & value[n].isNotNull()
    good = F.coalesce(whole & body.rlike(r"(?s)^\{.*\}$"), F.lit(False))
    return F.struct(F.when(good, value).alias("value"), F.when(~good, "INVALID_REPLY").alias("error"))


def phase_contract(phase: Column, intent: Column, workflow: Column) -> Column:
    """The error of a request: a PLAN carries no decision, an ANALYZE needs intent and workflow; null where all is well."""
    return F.when((phase == "PLAN") & (intent.isNotNull() | workflow.isNotNull()), "PLAN_WITH_DECISION").when((phase == "ANALYZE") & (intent.isNull() | workflow.isNull()), "ANALYZE_WITHOUT_DECISION").when(~F.coalesce(phase.isin("PLAN", "ANALYZE"), F.lit(False)), "UNKNOWN_PHASE")


def route_outcome(route: Column, notice: Column) -> Column:
    """(status, outcome, scenario, review) of a route; asking a worker without a usable notice needs a person."""
    of = lambda i: F.coalesce(*[F.when(route == k, v[i]) for k, v in OUTCOMES.items()])
    review = (route == "ask_worker") & (F.coalesce(strip(notice), F.lit("")) == "")
    return F.struct(F.when(review, "READY_FOR_REVIEW").otherwise(of(0)).alias("status"), F.when(review, "REVIEW_REQUIRED").otherwise(of(1)).alias("outcome"), of(2).alias("scenario"), F.coalesce(review, F.lit(False)).alias("review"))


def approved_dictionary(status: Column, reviewer: Column, review_date: Column, found: Column, expected: Column, *, allow_draft: bool = False) -> Column:
    """The error of a glossary: its digest must be the expected one, and unless drafts are allowed it must be approved, with a reviewer and an ISO date; null where it may be used."""
    error = F.when(~F.coalesce(F.lower(strip(expected)) == F.lower(found), F.lit(False)), "CHECKSUM_MISMATCH")
    if not allow_draft:
        error = error.when(F.coalesce(status, F.lit("")) != "approved", "NOT_APPROVED").when(F.coalesce(strip(reviewer), F.lit("")) == "", "REVIEWER_MISSING").when(~F.coalesce(strip(review_date).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)), "REVIEW_DATE_INVALID")
    return error
