"""Recognised identity documents: templates, fields, review reasons.

A response has ``document_type`` (passport_copy or arc), ``country_code`` and ``images``: array of (inferResult, matchedTemplate (id), fields: array of (name, inferText, inferConfidence)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.fields import mrz_birth_date, parse_document_date
from caseflow.functions.text import clean_identifier, collapse_spaces, strip

#: Templates of passports by country, of residence cards by side, aliases of country codes.
PASSPORT_TEMPLATES = {"KOR": 43019, "PHL": 43021, "JPN": 43022, "CHN": 43023, "VNM": 43038}
CARD_SIDES = {43024: "front", 43025: "back"}
COUNTRY_ALIASES = {"KR": "KOR", "PH": "PHL", "JP": "JPN", "CN": "CHN", "VN": "VNM"}
DEFAULT_COUNTRY, DAY_FIRST_TEMPLATE = "VNM", 43038
#: Fields that are kept, those that are dates, identifiers and required.
APPROVED_FIELDS = [
    "passport_number", "surname", "given_names", "nationality", "date_of_birth", "sex", "passport_issue_date", "passport_expiry_date", "alien_registration_number", "visa_type",
    "stay_expiration_date", "residence_address_1",
]
DATE_FIELDS = ["date_of_birth", "passport_issue_date", "passport_expiry_date", "stay_expiration_date"]
IDENTIFIERS = ["passport_number", "alien_registration_number"]
PASSPORT_REQUIRED = ["date_of_birth", "given_names", "passport_expiry_date", "passport_number", "surname"]
CARD_FRONT_REQUIRED = ["alien_registration_number"]
BACK_PREFIXES = ("stay_", "residence_")
#: The error code of a first reason.
ERROR_CODES = {"multiple_images": "MULTIPLE_IMAGES", "template_not_matched": "TEMPLATE_NOT_MATCHED", "unexpected_template": "TEMPLATE_NOT_MATCHED"}
#: What a file must be to be recognised.
CONTENT_TYPES, MOST_BYTES = ["image/jpeg", "image/png", "application/pdf"], 20 * 1024 * 1024


def resolve_template(documents: DataFrame) -> DataFrame:
    """Adds template_ids (null: unsupported country): both sides of a residence card, else the passport of the country, by its alias, blank ones by default."""
    country = F.upper(strip(F.coalesce("country_code", F.lit(""))))
    aliases = F.create_map(*[F.lit(x) for pair in COUNTRY_ALIASES.items() for x in pair])
    templates = F.create_map(*[F.lit(x) for pair in PASSPORT_TEMPLATES.items() for x in pair])
    code = F.when(country == "", DEFAULT_COUNTRY).otherwise(F.coalesce(F.try_element_at(aliases, country), country))
    passport = F.try_element_at(templates, code)
    ids = F.when(F.lower("document_type") == "arc", F.array(*map(F.lit, CARD_SIDES))).when(passport.isNotNull(), F.array(passport))
    return documents.withColumn("template_ids", ids)


def template_side(template_id: Column) -> Column:
    return F.coalesce(*[F.when(template_id == k, v) for k, v in CARD_SIDES.items()])


def file_admission(files: DataFrame, *, name_col: str = "filename", type_col: str = "content_type", size_col: str = "length") -> DataFrame:
    """Adds error of files that are not admitted: empty, wrong type, too large, unsafe name; the first that holds."""
    name = F.coalesce(F.col(name_col), F.lit(""))
    unsafe = name.isin("", ".", "..") | name.rlike(r"[/\\\x00]")
    error = (
        F.when(F.coalesce(F.col(size_col), F.lit(0)) == 0, "FILE_EMPTY")
        .when(~F.coalesce(F.col(type_col).isin(*CONTENT_TYPES), F.lit(False)), "UNSUPPORTED_CONTENT_TYPE")
        .when(F.col(size_col) > MOST_BYTES, "FILE_TOO_LARGE")
        .when(unsafe, "INVALID_FILENAME")
    )
    return files.withColumn("error", error)


def approved_fields(fields: DataFrame) -> DataFrame:
    """Recognised fields (name, text, ...) of approved names that are not blank."""
    return fields.where(F.col("name").isin(*APPROVED_FIELDS) & (strip(F.coalesce("text", F.lit(""))) != ""))


def _confidence(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(c, F.lit(0.0))))


def _settled(fields: Column, day_first: Column) -> Column:
    """(name, value, confidence, invalid) of each approved name, after its repeats in order: a repeat of lower confidence changes nothing; a date that can't be read takes the value away, so that any later one counts."""
    approved = F.filter(fields, lambda f: f["name"].isin(*APPROVED_FIELDS) & (strip(F.coalesce(f["inferText"], F.lit(""))) != ""))
    day = lambda t: F.date_format(F.when(day_first, parse_document_date(t, day_first=True)).otherwise(parse_document_date(t)), "yyyy-MM-dd")
    read = F.transform(
        approved,
        lambda f: F.struct(
            f["name"].alias("name"),
            F.when(f["name"].isin(*DATE_FIELDS), day(f["inferText"])).when(f["name"].isin(*IDENTIFIERS), clean_identifier(f["inferText"])).otherwise(collapse_spaces(strip(f["inferText"]))).alias("value"),
            _confidence(f["inferConfidence"]).alias("confidence"),
        ),
    )
    begin = F.struct(F.lit(None).cast("string").alias("value"), F.lit(None).cast("double").alias("confidence"), F.lit(False).alias("invalid"))

    def settle(name: Column) -> Column:
        def step(acc: Column, f: Column) -> Column:
            weaker = acc["confidence"].isNotNull() & (f["confidence"] < acc["confidence"])
            kept = F.struct(f["value"].alias("value"), F.when(f["value"].isNotNull(), f["confidence"]).alias("confidence"), (acc["invalid"] | f["value"].isNull()).alias("invalid"))
            return F.when(weaker, acc).otherwise(kept)

        done = F.aggregate(F.filter(read, lambda f: f["name"] == name), begin, step)
        return F.struct(name.alias("name"), done["value"].alias("value"), done["confidence"].alias("confidence"), done["invalid"].alias("invalid"))

    return F.transform(F.array_distinct(F.transform(read, lambda f: f["name"])), settle)


def ocr_review(responses: DataFrame, *, threshold: float = 0.8, as_of: str) -> DataFrame:
    """Adds template_id, side, fields (map), confidences (map), review_reasons (in order), status and error_code (of the first reason).

    Reasons: several images; no or an unexpected template, after which nothing is read; dates that can't be read, in the order in which they come; missing required fields;
    a card's back without a field, or with none above the threshold; required fields below it. Documents with day-first dates may give name and birth date by their machine-readable zone.
    """
    rows = resolve_template(responses)
    image = F.try_element_at("images", F.lit(1))
    template = image["matchedTemplate"]["id"]
    ok = F.coalesce((image["inferResult"] == "SUCCESS") & template.isNotNull(), F.lit(False))
    expected = F.coalesce(F.array_contains("template_ids", template), F.lit(False))
    card = F.lower("document_type") == "arc"
    rows = rows.withColumns({"__image": image, "__template": template, "__ok": ok, "__open": ok & expected, "__several": F.coalesce(F.size("images"), F.lit(0)) > 1})
    rows = rows.withColumn("__none", F.coalesce(F.size("images"), F.lit(0)) <= 0).withColumn("side", F.when(F.col("__open") & card, template_side(F.col("__template"))))
    no_fields = F.array().cast("array<struct<name:string,inferText:string,inferConfidence:double>>")
    source = F.when(F.col("__open"), F.coalesce(F.col("__image")["fields"], no_fields)).otherwise(no_fields)
    day_first = F.coalesce(F.col("__template") == DAY_FIRST_TEMPLATE, F.lit(False))
    rows = rows.withColumn("__fields", F.transform(source, lambda f: F.struct(f["name"].alias("name"), f["inferText"].alias("inferText"), f["inferConfidence"].cast("double").alias("inferConfidence"))))
    rows = rows.withColumn("__read", _settled(F.col("__fields"), day_first))
    # names and birth dates that the machine-readable zone and the whole name add
    last = lambda name: F.when(day_first, F.try_element_at(F.filter("__fields", lambda f: (f["name"] == name) & (strip(F.coalesce(f["inferText"], F.lit(""))) != "")), F.lit(-1)))
    rows = rows.withColumns({"__whole": last("full_name"), "__mrz": last("mrz")})
    parts = F.split(strip(F.col("__whole")["inferText"]), r"(?U)\s+")
    by_name = lambda name: F.try_element_at(F.filter("__read", lambda f: f["name"] == name), F.lit(1))
    named = F.coalesce(F.size(parts), F.lit(0)) >= 2
    birth = F.date_format(mrz_birth_date(F.col("__mrz")["inferText"], F.to_date(F.lit(as_of))), "yyyy-MM-dd")
    sure = lambda c: _confidence(F.col(c)["inferConfidence"])
    born = by_name("date_of_birth")["value"].isNull() & birth.isNotNull()
    added = {"surname": (named, parts[0], sure("__whole")), "given_names": (named, F.array_join(F.slice(parts, 2, 1000), " "), sure("__whole")), "date_of_birth": (born, birth, sure("__mrz"))}

    def field(name: str) -> Column:
        read = by_name(name)
        value, confidence, seen, invalid = read["value"], read["confidence"], read.isNotNull(), F.coalesce(read["invalid"], F.lit(False))
        if name in added:
            given, more, how = added[name]
            given = F.coalesce(given, F.lit(False))
            empty = given & value.isNull()
            value, confidence = F.when(empty, more).otherwise(value), F.when(given & confidence.isNull(), how).otherwise(confidence)
            seen = seen | given
            if name == "date_of_birth":
                invalid = invalid & ~given
        return F.struct(F.lit(name).alias("name"), value.alias("value"), confidence.alias("confidence"), seen.alias("seen"), invalid.alias("invalid"))

    rows = rows.withColumn("__all", F.array(*[field(n) for n in APPROVED_FIELDS]))
    # unreadable dates in the order in which they first fail: by the place of the first unreadable repeat
    of = lambda name: F.element_at(F.filter("__all", lambda f: f["name"] == name), 1)
    order = F.transform("__read", lambda f: f["name"])
    invalid = F.filter(order, lambda n: F.exists("__all", lambda f: (f["name"] == n) & f["invalid"]))
    missing = lambda name: ~of(name)["seen"] | (of(name)["value"].isNull() & F.lit(name not in DATE_FIELDS))
    low = lambda name: F.coalesce(of(name)["confidence"] < threshold, F.lit(False))
    passport, front, back = F.col("__open") & ~card, F.col("side") == "front", F.coalesce(F.col("side") == "back", F.lit(False))
    backs = F.array_sort(F.transform(F.filter("__all", lambda f: f["seen"] & (f["name"].startswith(BACK_PREFIXES[0]) | f["name"].startswith(BACK_PREFIXES[1]))), lambda f: f["name"]))
    sure_back = F.exists("__all", lambda f: F.array_contains(backs, f["name"]) & (F.coalesce(f["confidence"], F.lit(0.0)) >= threshold))
    low_backs = F.filter(backs, lambda n: F.exists("__all", lambda f: (f["name"] == n) & f["confidence"].isNotNull()))
    no = F.array().cast("array<string>")
    says = lambda prefix, names: F.transform(names, lambda n: F.concat(F.lit(prefix), n))
    listed = lambda rule, names, test: F.when(rule, F.array_compact(F.array(*[F.when(test(n), n) for n in names]))).otherwise(no)
    required = lambda test: F.concat(listed(passport, PASSPORT_REQUIRED, test), listed(F.coalesce(front, F.lit(False)), CARD_FRONT_REQUIRED, test))
    reasons = F.concat(
        F.array_compact(F.array(F.when(F.col("__several"), "multiple_images"), F.when(F.col("__none") | ~F.col("__ok"), "template_not_matched"), F.when(F.col("__ok") & ~F.col("__open"), "unexpected_template"))),
        says("invalid_date:", invalid),
        says("missing_required:", required(missing)),
        F.when(back & (F.size(backs) == 0), F.array(F.lit("missing_required:arc_back_field"))).when(back & ~sure_back, says("low_confidence:", low_backs)).otherwise(no),
        says("low_confidence:", required(low)),
    )
    rows = rows.withColumn("review_reasons", reasons)
    first = F.try_element_at("review_reasons", F.lit(1))
    code = F.when(first.startswith("invalid_date:"), "INVALID_DATE").when(first.startswith("missing_required:"), "MISSING_REQUIRED_FIELD").when(first.startswith("low_confidence:"), "LOW_CONFIDENCE")
    for reason, name in ERROR_CODES.items():
        code = code.when(first == reason, name)
    held = F.filter("__all", lambda f: f["value"].isNotNull())
    out = rows.withColumns(
        {
            "template_id": F.when(F.col("__ok"), F.col("__template")),
            "fields": F.map_from_entries(F.transform(held, lambda f: F.struct(f["name"], f["value"]))),
            "confidences": F.map_from_entries(F.transform(F.filter("__all", lambda f: f["confidence"].isNotNull()), lambda f: F.struct(f["name"], f["confidence"]))),
            "status": F.when(F.size("review_reasons") > 0, "review_required").otherwise("succeeded"),
            "error_code": F.when(first.isNotNull(), code.otherwise("OCR_REVIEW_REQUIRED")),
        }
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")], "template_ids")
