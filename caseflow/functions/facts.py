"""Facts that a text must keep: protected tokens with their places, machine tokens, dates. Built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseflow.functions.text import nfc_strip

_END = "(?![A-Za-z0-9])"
_BEGIN = "(?<![A-Za-z0-9])"
#: Token kinds and their patterns, in the order in which they are tried.
TOKEN_PATTERNS = {
    "url": r"https?://[^\s<>\[\]{}\"]+",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "date": rf"{_BEGIN}(?:\d{{4}}-\d{{1,2}}-\d{{1,2}}|\d{{4}}년\s*\d{{1,2}}월\s*\d{{1,2}}일?|\d{{4}}[./]\s*\d{{1,2}}[./]\s*\d{{1,2}}){_END}",
    "time": rf"{_BEGIN}(?:\d{{1,2}}:\d{{2}}(?::\d{{2}})?|\d{{1,2}}시(?:\s*\d{{1,2}}분)?){_END}",
    "phone": rf"{_BEGIN}\+?\d{{1,3}}(?:[- ]\d{{1,4}}){{3,4}}{_END}",
    "currency": rf"(?:{_BEGIN}(?:USD|KRW|EUR|JPY|GBP|CNY|₩){_END}|(?<=\d)(?:억원|만원|천원|원){_END})",
    "unit": rf"(?i){_BEGIN}[-+]?(?:\d{{1,3}}(?:,\d{{3}})+|\d+)(?:\.\d+)?(?:kg|g|mg|L|ml|cm|m|개|명|건|부|장|회|일|%|퍼센트){_END}",
    "amount": rf"{_BEGIN}[-+]?(?:\d{{1,3}}(?:,\d{{3}})+(?:\.\d+)?|\d+\.\d+){_END}",
    "document_identifier": rf"{_BEGIN}[A-Za-z]{{2,}}(?:-[A-Za-z0-9]+)+(?:\.\d+)?{_END}",
    "version": rf"(?i){_BEGIN}v\d+(?:\.\d+)+{_END}",
    "number": rf"{_BEGIN}[-+]?\d+{_END}",
}
#: What machine tokens are, taken out of the text one after another; ``None`` is taken out but is no token.
MACHINE_STEPS = [
    ("url", r"https?://\S+"),
    ("email", r"[\p{L}\p{N}_.-]+@[\p{L}\p{N}_.-]+\.[\p{L}\p{N}_]+"),
    ("phone", r"\b\d{2,4}-\d{3,4}-\d{4}\b"),
    (None, r"\d{4}[-./년]\s*\d{1,2}[-./월]?\s*\d{1,2}일?"),
    ("money", r"\d{1,3}(?:,\d{3})*\s*(?:원|\$|USD|EUR|JPY)"),
    ("number", r"\d+(?:,\d{3})*(?:\.\d+)?"),
]
#: A stretch without digits between two letters that stand in no phone number, date, sum or number. All of these hold digits, so none reaches into it, and its ends stand for all of it.
_NEVER = r"[^\s\d\-./년월일,원$USDERJPY]"
BETWEEN_NUMBERS = rf"(?U)({_NEVER})\D*({_NEVER})"
#: What a text must hold for a kind to be in it; cheap to look for, so that the patterns run over few texts. They are wider than the patterns.
_DIGIT = r"\p{Nd}"
TOKEN_GATES = {
    "url": "http", "email": "@", "date": rf"{_DIGIT}{{4}}", "time": rf"{_DIGIT}(?:{_DIGIT}|:|시)", "phone": rf"{_DIGIT}[- ]{_DIGIT}", "currency": rf"USD|KRW|EUR|JPY|GBP|CNY|₩|{_DIGIT}(?:억|만|천|원)",
    "unit": rf"{_DIGIT}(?:[kKgGmMlLcC%\u212A]|개|명|건|부|장|회|일|퍼센트)", "amount": rf"{_DIGIT}[.,]{_DIGIT}", "document_identifier": r"[A-Za-z]-[A-Za-z0-9]", "version": rf"[vV]{_DIGIT}", "number": _DIGIT,
}
TOKEN = "array<struct<start:int,stop:int,kind:string,surface:string>>"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str) -> Column:
    """All matches of a pattern: (start, stop, value); the gaps that ``split`` leaves give the places."""
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda found: _placed(text, pattern, found))


def _placed(text: Column, pattern: str, found: Column) -> Column:
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    pairs = F.slice(F.arrays_zip(found.alias("value"), gaps.alias("gap")), 1, F.size(found))
    none = F.array().cast("array<struct<start:int,stop:int,value:string>>")
    begin = F.struct(F.lit(0).alias("at"), none.alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]
        stop = start + F.length(p["value"])
        return F.struct(stop.alias("at"), F.concat(acc["spans"], F.array(F.struct(start.alias("start"), stop.alias("stop"), p["value"].alias("value")))).alias("spans"))

    return F.when(F.size(found) > 0, F.aggregate(pairs, begin, step, lambda acc: acc["spans"])).otherwise(none)


def _iso(surface: Column) -> Column:
    """The ISO form of a date in one of three notations; what is no date stays as it is."""
    parts = F.split(F.regexp_replace(F.regexp_replace(surface, "일$", ""), r"(?U)\s*[-./년월]\s*", "-"), "-")
    made = parse_date(parts[0], parts[1], parts[2])
    return F.coalesce(F.date_format(made, "yyyy-MM-dd"), surface)


def parse_date(year: Column, month: Column, day: Column) -> Column:
    """A date from its parts as text; null if there is no such day."""
    text = F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return let(text, lambda t: F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$") & ~t.startswith("0000"), F.try_to_date(t, "yyyy-MM-dd")))


def canonical_token(kind: Column, surface: Column) -> Column:
    """Amounts without commas, units in small letters, dates in ISO form; all else unchanged."""
    return F.when(kind == "amount", F.replace(surface, F.lit(","), F.lit(""))).when(kind == "unit", F.lower(surface)).when(kind == "date", _iso(surface)).otherwise(surface)


def extract_facts(text: Column, *, clean: bool = False) -> Column:
    """Protected tokens of a text, by place: (start, stop, kind, surface, canonical). Kinds are tried in order, and a match that overlaps one of an earlier kind is no token.

    URLs lose the punctuation at their end; a whole quantity with a unit is also a number. Null and empty texts have none. ``clean`` texts are stripped and in NFC already.
    """
    whole = r"^[-+]?(?:\d{1,3}(?:,\d{3})+|\d+)"

    def of_kind(text: Column, kind: str, pattern: str) -> Column:
        found = F.when(text.rlike(TOKEN_GATES[kind]), located(text, f"(?U){pattern}")).otherwise(F.array().cast("array<struct<start:int,stop:int,value:string>>"))
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["stop"].alias("stop"), F.lit(kind).alias("kind"), m["value"].alias("surface")))

    def free(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda a: (a["start"] < x["stop"]) & (x["start"] < a["stop"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    def number(x: Column) -> Column:
        digits = F.regexp_extract(x["surface"], whole, 0)
        return F.struct(x["start"].alias("start"), (x["start"] + F.length(digits)).alias("stop"), F.lit("number").alias("kind"), digits.alias("surface"))

    def finished(kept: Column) -> Column:
        whole_units = F.filter(kept, lambda x: (x["kind"] == "unit") & ~x["surface"].rlike(whole + r"\."))
        ordered = F.array_sort(F.concat(kept, F.transform(whole_units, number)))
        return F.transform(ordered, lambda x: x.withField("canonical", canonical_token(x["kind"], x["surface"])))

    def facts(text: Column) -> Column:
        kept = F.aggregate(F.concat(*[of_kind(text, kind, pattern) for kind, pattern in TOKEN_PATTERNS.items()]), F.array().cast(TOKEN), free)
        trimmed = F.transform(kept, lambda x: x.withField("surface", F.when(x["kind"] == "url", F.regexp_replace(x["surface"], "[.,;:!?]+$", "")).otherwise(x["surface"])))
        return let(trimmed, finished)

    return let(F.coalesce(text if clean else nfc_strip(text), F.lit("")), facts)


def machine_tokens(text: Column) -> Column:
    """URLs, emails, phone numbers, sums and numbers of a text, each taken out before the next is looked for; dates are taken out but are no tokens. What holds digits is looked for in what is near digits."""
    none = F.array().cast("array<string>")

    def without(tokens: Column, part: str) -> Column:
        return F.transform(tokens, lambda t: F.replace(t, F.lit(part), F.lit("")))

    def from_step(at: int, rest: Column, near: bool = False) -> Column:
        kind, pattern = MACHINE_STEPS[at]
        if kind == "phone" and not near:
            return let(F.when(rest.rlike(_DIGIT), F.regexp_replace(rest, BETWEEN_NUMBERS, "$1$2")).otherwise(""), lambda left: from_step(at, left, True))
        last, wide = at + 1 == len(MACHINE_STEPS), f"(?U){pattern}"
        there = rest.rlike({"url": "http", "email": "@"}.get(kind, _DIGIT))
        tokens = F.regexp_extract_all(rest, F.lit(wide), F.lit(0))
        drop = {"money": " ", "number": ","}.get(kind)
        found = F.when(there, without(tokens, drop) if drop else tokens).otherwise(none) if kind else none
        # what is left is computed once, though two steps use it
        return found if last else F.concat(found, let(F.when(there, F.regexp_replace(rest, wide, "")).otherwise(rest), lambda left: from_step(at + 1, left)))

    return let(F.coalesce(text, F.lit("")), lambda rest: from_step(0, rest))


def first_date(text: Column) -> Column:
    """The first year-month-day with - . or /, else the first Korean date; null if there is none or if it is no day."""
    signed, korean = r"(\d{4})[-./](\d{1,2})[-./](\d{1,2})", r"(?U)(\d{4})\s*년\s*(\d{1,2})\s*월\s*(\d{1,2})\s*일?"
    by = lambda p: parse_date(*[F.regexp_extract(text, p, i) for i in (1, 2, 3)])
    return F.when(text.rlike(signed), by(signed)).when(text.rlike(korean), by(korean))
