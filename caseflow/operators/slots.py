"""Slots of a case: seeding, merging, missing ones, questions, identity documents, routes and messages.

Slots are maps from name to text. A key that is present counts as present whatever its value; a value that is null or empty is falsy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.functions.facts import let
from caseflow.functions.text import strip

#: Slots that identity documents give, slots a renewal needs of the contract, slots that staff are never asked for.
IDENTITY_SLOTS = ["passport_number", "alien_registration_number", "nationality", "full_name", "date_of_birth"]
CONTRACT_SLOTS = ["due_at", "wage", "working_hours", "job_description", "work_location", "lodging", "contract_period"]
EXCLUDED_SLOTS = ["passport_status", "arc_status", "arc_expiry_date"]
#: Keys a worker's record gives, and where else they go.
WORKER_KEYS = ["worker_id", "stay_expiry_date", "contract_end_date", "contract_start_date", "nationality_code", "preferred_language", "work_status", "display_name"]
ALSO = {"display_name": "full_name", "nationality_code": "nationality"}
#: Where a missing slot can be found; all others are asked of the user.
SOURCE_HINTS = {
    "worker_id": "REQUEST", "company_id": "REQUEST", "stay_expiry_date": "WORKER_DB", "contract_end_date": "WORKER_DB", "contract_start_date": "WORKER_DB", "display_name": "WORKER_DB",
    "full_name": "WORKER_DB", "nationality": "WORKER_DB", "nationality_code": "WORKER_DB", "preferred_language": "WORKER_DB", "work_status": "WORKER_DB",
    "passport_number": "DOCUMENT_OCR", "alien_registration_number": "DOCUMENT_OCR", "date_of_birth": "DOCUMENT_OCR",
}
#: Questions for slots.
PROMPTS = {
    "worker_id": "대상 근로자를 지정해 주세요.", "due_at": "업무 준비를 마칠 날짜와 시간을 입력해 주세요.", "stay_expiry_date": "체류 만료일을 입력해 주세요.", "contract_end_date": "계약 종료일을 입력해 주세요.",
    "contract_start_date": "계약 시작일을 입력해 주세요.", "legal_name": "여권상 성명을 입력해 주세요.", "full_name": "성명을 입력해 주세요.", "monthly_wage": "월 급여를 입력해 주세요.", "wage": "급여를 입력해 주세요.",
    "document_type": "서류 종류를 입력해 주세요.", "pay_period": "급여 기간을 입력해 주세요.", "change_type": "고용 변동 유형을 입력해 주세요.",
}
#: Documents to ask for.
ITEM_LABELS = {"passport_number": "여권 사본 1부", "alien_registration_number": "외국인등록증 사본 1부", "nationality": "국적 확인 서류", "full_name": "성명 확인 서류", "date_of_birth": "생년월일 확인 서류"}
DEFAULT_ITEMS = ["여권 사본 1부", "외국인등록증 사본 1부"]
#: What an expired stay's status leads to: action, question, suggested workflows, signals.
EXPIRED_STAY = {
    "APPROVED": ("REVIEW_UPDATED_EXPIRY_DATE", "new_stay_expiry_date", [], ["REVIEW_STAY_APPROVAL_EVIDENCE"]),
    "APPLICATION_PENDING": ("TRACK_APPLICATION_RESULT", "next_review_at", [], ["WAIT_FOR_EXTERNAL_STAY_RESULT"]),
    "NOT_APPLIED": ("REQUEST_HR_STATUS_CONFIRMATION", "stay_verification_evidence", [], ["REVIEW_STAY_EXCEPTION"]),
    "EMPLOYMENT_ENDED": ("REVIEW_EMPLOYMENT_CHANGE", "employment_end_evidence", ["WF-CHG-001"], ["SUGGEST_EMPLOYMENT_CHANGE_REVIEW"]),
    "UNKNOWN": ("REQUEST_HR_STATUS_CONFIRMATION", "stay_verification_status", [], ["REVIEW_STAY_EXCEPTION"]),
}
#: Names under which recognised fields become slots.
OCR_ALIASES = {
    "passport_number": "passport_number", "alien_registration_number": "alien_registration_number", "date_of_birth": "date_of_birth", "nationality": "nationality", "full_name": "full_name",
    "legal_name": "full_name", "stay_expiration_date": "stay_expiry_date", "residence_address_1": "address_in_korea",
}
EMPTY_MAP = "map<string,string>"


def no_slots() -> Column:
    return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))


def _truthy(v: Column) -> Column:
    return F.coalesce(v, F.lit("")) != ""


def overlay(base: Column, more: Column, *, wins: Column | None = None) -> Column:
    """``base`` with the truthy entries of ``more``: absent keys always, present ones only where ``wins`` (an array of names) holds them."""
    absent = lambda maps, k: ~F.map_contains_key(maps["base"], k)
    fills = absent if wins is None else lambda maps, k: absent(maps, k) | F.array_contains(wins, k)
    # both maps and what fills are used in several places, so each is computed once
    both = F.struct(F.coalesce(base, no_slots()).alias("base"), F.coalesce(more, no_slots()).alias("more"))
    filled = lambda maps: F.map_filter(maps["more"], lambda k, v: _truthy(v) & fills(maps, k))
    merged = lambda base, fill: F.map_zip_with(base, fill, lambda k, a, b: F.when(F.map_contains_key(fill, k), b).otherwise(a))
    return let(both, lambda maps: let(filled(maps), lambda fill: merged(maps["base"], fill)))


def pairs_map(pairs: dict[str, Column]) -> Column:
    """A map of the named columns whose values are truthy."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in pairs.items()])
    return F.map_from_entries(F.filter(entries, lambda e: _truthy(e["value"])))


def enrich_case(cases: DataFrame, workers: DataFrame, companies: DataFrame) -> DataFrame:
    """Adds to ``slots`` what is absent there, from the worker, the company and the task's JSON (``business_data``), in this order; later sources never replace earlier ones."""
    worker = pairs_map({k: F.col(f"w.{k}") for k in WORKER_KEYS} | {to: F.col(f"w.{k}") for k, to in ALSO.items()})
    company = pairs_map({"company_id": F.col("c.company_id"), "enterprise_name": F.col("c.name")})
    rows = cases.alias("x").join(workers.alias("w"), F.col("x.worker_id") == F.col("w.worker_id"), "left").join(companies.alias("c"), F.col("x.company_id") == F.col("c.company_id"), "left")
    task = F.coalesce(F.from_json(F.col("x.business_data"), EMPTY_MAP), no_slots())
    slots = overlay(overlay(overlay(F.col("x.slots"), worker), company), task)
    return rows.select("x.case_id", slots.alias("slots"))


def merge_ocr_slots(cases: DataFrame) -> DataFrame:
    """``slots`` with the fields of ``ocr_fields``: identity fields replace, others fill what is absent; blanks are ignored."""
    return cases.withColumn("slots", overlay(F.col("slots"), F.col("ocr_fields"), wins=F.array(*map(F.lit, IDENTITY_SLOTS))))


def seed_worker_slots(workers: DataFrame) -> DataFrame:
    """Adds slots: the worker's own columns and ``requested_fields``; the latter fill what is absent, and a legal name also fills the full name."""
    own = pairs_map({"worker_id": F.col("worker_ref"), **{k: F.col(k) for k in ("display_name", "nationality_code", "stay_expiry_date", "contract_start_date", "contract_end_date")}, **{to: F.col(k) for k, to in ALSO.items()}})
    seeded = overlay(own, F.col("requested_fields"))
    legal = F.map_filter(F.create_map(F.lit("full_name"), F.try_element_at("requested_fields", F.lit("legal_name"))), lambda k, v: _truthy(v))
    return workers.withColumn("slots", overlay(seeded, legal))


def renewal_missing_slots(cases: DataFrame) -> DataFrame:
    """Adds missing_slots: required keys that are absent, without those staff are never asked for; for renewals also the identity and contract slots that are falsy."""
    none = F.array().cast("array<string>")
    base = F.array_except(F.array_except(F.coalesce("required_slots", none), F.map_keys("slots")), F.array(*map(F.lit, EXCLUDED_SLOTS)))
    falsy = F.filter(F.array(*map(F.lit, IDENTITY_SLOTS + CONTRACT_SLOTS)), lambda k: ~_truthy(F.try_element_at("slots", k)))
    return cases.withColumn("missing_slots", F.when(F.col("intent") == "EXPIRY_RENEWAL", F.array_distinct(F.concat(base, falsy))).otherwise(base))


def suggest_fields(missing: Column) -> Column:
    """(key, source_hint) of each missing slot once, in order."""
    hints = F.create_map(*[F.lit(x) for pair in SOURCE_HINTS.items() for x in pair])
    keys = F.filter(F.array_distinct(missing), _truthy)
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.coalesce(F.try_element_at(hints, k), F.lit("USER_INPUT")).alias("source_hint")))


def compose_questions(missing: Column) -> Column:
    """(slot_key, prompt) of each missing slot; slots without a prompt of their own get a templated one."""
    known = F.create_map(*[F.lit(x) for pair in PROMPTS.items() for x in pair])
    return F.transform(missing, lambda k: F.struct(k.alias("slot_key"), F.coalesce(F.try_element_at(known, k), F.concat(k, F.lit(" 값을 입력해 주세요."))).alias("prompt")))


def normalize_ocr_fields(raw: Column) -> Column:
    """Recognised fields as slots: known names by their alias, blanks left out; surname and given names make a full name if there is none."""
    raw = F.coalesce(raw, no_slots())
    alias = F.create_map(*[F.lit(x) for pair in OCR_ALIASES.items() for x in pair])
    known = F.filter(F.map_entries(raw), lambda e: _truthy(e["value"]) & F.map_contains_key(alias, e["key"]))
    # of two names for one slot the later in alphabetical order of the names stands
    named = F.transform(F.array_sort(known), lambda e: F.struct(F.element_at(alias, e["key"]).alias("key"), e["value"].alias("value")))
    last = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named) + 1), lambda o: o["key"] == e["key"]))
    fields = F.map_from_entries(last)
    given = F.coalesce(F.nullif(F.try_element_at(raw, F.lit("given_names")), F.lit("")), F.try_element_at(raw, F.lit("givenNames")))
    parts = F.filter(F.array(F.try_element_at(raw, F.lit("surname")), given), _truthy)
    whole = F.when(F.size(parts) > 0, F.array_join(F.transform(parts, strip), " "))
    return overlay(fields, F.map_filter(F.create_map(F.lit("full_name"), whole), lambda k, v: _truthy(v)))


def identity_presence(cases: DataFrame) -> DataFrame:
    """Adds passport, alien_registration (present, missing, unknown), combo and missing_identity_slots, from slots, ocr_fields and the array document_types.

    A status slot decides first; then uploads and known numbers; then a number slot that is there without a value; without any document a missing number means a missing document.
    """
    slots, ocr = F.coalesce("slots", no_slots()), F.coalesce("ocr_fields", no_slots())
    types = F.transform(F.coalesce("document_types", F.array().cast("array<string>")), lambda t: F.lower(F.coalesce(t, F.lit(""))))
    held = lambda k: _truthy(F.try_element_at(slots, F.lit(k))) | _truthy(F.try_element_at(ocr, F.lit(k)))

    def presence(status: str, number: str, camel: str, words: list[str]) -> Column:
        stated = F.upper(strip(F.coalesce(F.try_element_at(slots, F.lit(status)), F.lit(""))))
        upload = F.exists(types, lambda t: F.greatest(*[F.contains(t, F.lit(w)) for w in words]))
        blank = F.map_contains_key(slots, F.lit(number)) & F.coalesce(F.try_element_at(slots, F.lit(number)), F.lit("")).isin("", "missing")
        return (
            F.when(stated == "MISSING", "missing").when(stated.isin("SUBMITTED", "VERIFIED"), "present").when(upload | held(number) | held(camel), "present").when(blank, "missing")
            .when(~held(number) & (F.size(types) == 0), "missing").otherwise("unknown")
        )

    passport = presence("passport_status", "passport_number", "passportNumber", ["passport", "여권"])
    alien = presence("arc_status", "alien_registration_number", "alienRegistrationNumber", ["alien", "registration", "등록증", "arc"])
    combo = (
        F.when((F.col("passport") == "present") & (F.col("alien_registration") == "present"), "both_present")
        .when(F.col("passport") == "present", "passport_only")
        .when(F.col("alien_registration") == "present", "alien_only")
        .when((F.col("passport") == "missing") & (F.col("alien_registration") == "missing"), "both_missing")
        .otherwise("partial_unknown")
    )
    missing = F.array_compact(F.array(*[F.when(~held(k), k) for k in IDENTITY_SLOTS]))
    return cases.withColumn("passport", passport).withColumn("alien_registration", alien).withColumn("combo", combo).withColumn("missing_identity_slots", missing)


def route_case(cases: DataFrame) -> DataFrame:
    """Adds route and signals, by the first rule that holds, to cases with the columns of ``identity_presence``, intent, outcome, missing_slots and document_types."""
    none = F.array().cast("array<string>")
    missing = F.coalesce("missing_slots", none)
    identity = F.size(F.array_intersect(missing, F.array(*map(F.lit, IDENTITY_SLOTS)))) > 0
    other = F.size(F.array_except(missing, F.array(*map(F.lit, IDENTITY_SLOTS + EXCLUDED_SLOTS)))) > 0
    has_docs, has_ocr = F.coalesce(F.size("document_types"), F.lit(0)) > 0, F.coalesce(F.size("ocr_fields"), F.lit(0)) > 0
    ask = F.col("combo").isin("both_missing", "passport_only", "partial_unknown") & (identity | (F.size("missing_identity_slots") > 0)) & ~has_ocr
    signals = F.array_compact(F.array(F.lit("REQUEST_IDENTITY_DOCUMENT"), F.when(F.col("passport") == "missing", "REQUEST_PASSPORT"), F.when(F.col("alien_registration").isin("missing", "unknown"), "REQUEST_ALIEN_REGISTRATION")))
    fixed = lambda *s: F.array(*map(F.lit, s))
    rules = [
        ((F.coalesce("outcome", F.lit("")) == "OUT_OF_SCOPE") | (F.coalesce("intent", F.lit("")) == "OUT_OF_SCOPE"), "out_of_scope", none),
        (has_docs & ~has_ocr, "ocr", fixed("RUN_OCR")),
        (~_truthy(F.col("intent")), "ask_hr", fixed("NEEDS_INFO")),
        (ask, "ask_worker", signals),
        (other, "ask_hr", fixed("REQUEST_CONTRACT_SLOTS", "NEEDS_INFO")),
    ]
    route, sent = F.lit("generate"), fixed("GENERATE_DRAFTS", "READY_FOR_REVIEW")
    for rule, name, with_signals in reversed(rules):
        route, sent = F.when(rule, name).otherwise(route), F.when(rule, with_signals).otherwise(sent)
    return cases.withColumn("route", route).withColumn("signals", sent)


def expired_stay(cases: DataFrame, *, status_col: str = "status") -> DataFrame:
    """Adds next_action, question_key, suggested_workflows and case_signals of an expired stay's status; null and unknown ones count as UNKNOWN."""
    status = F.upper(strip(F.coalesce(F.col(status_col), F.lit(""))))
    of = lambda i, lit: F.coalesce(*[F.when(status == k, lit(v[i])) for k, v in EXPIRED_STAY.items()], lit(EXPIRED_STAY["UNKNOWN"][i]))
    words = lambda v: F.array(*map(F.lit, v)).cast("array<string>")
    return cases.withColumns({"next_action": of(0, F.lit), "question_key": of(1, F.lit), "suggested_workflows": of(2, words), "case_signals": of(3, words)})


def ask_worker_request(cases: DataFrame, *, as_of: str) -> DataFrame:
    """Adds requested_items (labels of missing identity slots in order, else the usual two) and deadline (stay's or contract's end, else 14 days after ``as_of``)."""
    labels = F.create_map(*[F.lit(x) for pair in ITEM_LABELS.items() for x in pair])
    asked = F.array_intersect(F.coalesce("missing_slots", F.array().cast("array<string>")), F.array(*map(F.lit, IDENTITY_SLOTS)))
    items = F.when(F.size(asked) > 0, F.transform(asked, lambda k: F.element_at(labels, k))).otherwise(F.array(*map(F.lit, DEFAULT_ITEMS)))
    slot = lambda k: F.nullif(F.try_element_at("slots", F.lit(k)), F.lit(""))
    day = F.substring(F.coalesce(slot("stay_expiry_date"), slot("contract_end_date")), 1, 10)
    deadline = F.coalesce(F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd")), F.date_add(F.to_date(F.lit(as_of)), 14))
    return cases.withColumns({"requested_items": items, "deadline": deadline})


def worker_message(outputs: DataFrame) -> DataFrame:
    """Adds message: standard text, easy text unless it is the same, translation, with a blank line between; null where a person must look first."""
    text = lambda c: F.nullif(strip(F.col(c)), F.lit(""))
    easy = F.when(F.col("easy_text") != F.col("standard_text"), text("easy_text"))
    blocked = F.col("requires_human_review") | (F.col("generation_status") != "success")
    return outputs.withColumn("message", F.when(~blocked, F.concat_ws("\n\n", text("standard_text"), easy, text("translated_text"))))


def field_status(fields: DataFrame) -> DataFrame:
    """(case_id, template_id, fields, filled, empty_text, checkboxes): the names of a template's fields by what became of them, in order. ``fields`` has name, type and value."""
    text, box = F.coalesce("type", F.lit("text")) == "text", F.col("type") == "checkbox"
    names = lambda rule: F.sort_array(F.collect_set(F.when(rule, F.col("name"))))
    return fields.groupBy("case_id", "template_id").agg(
        names(F.lit(True)).alias("fields"), names(_truthy(F.col("value"))).alias("filled"), names(text & ~_truthy(F.col("value"))).alias("empty_text"), names(box).alias("checkboxes")
    )


def upsert_identity_slots(saves: DataFrame, workers: DataFrame) -> DataFrame:
    """Workers with the values of their saves (worker_id, seq, key, value) laid over ``slots``, the latest of each key; saves of unknown workers change nothing."""
    latest = saves.groupBy("worker_id", "key").agg(F.max_by("value", "seq").alias("value"))
    maps = latest.groupBy("worker_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("saved"))
    held = workers.join(maps, "worker_id", "left")
    keep = F.map_filter(F.coalesce("slots", no_slots()), lambda k, v: ~F.map_contains_key(F.coalesce("saved", no_slots()), k))
    return held.withColumn("slots", F.map_concat(keep, F.coalesce("saved", no_slots()))).drop("saved")


def analyze_phase(requests: DataFrame) -> DataFrame:
    """Adds status and keys to requests (phase, intent, required_slots, slots; no slots: no worker): out of scope; a PLAN gives the keys to ask for; an ANALYZE has no worker,
    lacks keys (which are asked for) or is a candidate."""
    none = F.array().cast("array<string>")
    missing = F.array_except("required_slots", F.map_keys(F.map_filter(F.coalesce("slots", no_slots()), lambda k, v: _truthy(v))))
    outside, plan = F.coalesce(F.col("intent") == "OUT_OF_SCOPE", F.lit(False)), F.col("phase") == "PLAN"
    status = F.when(outside, "OUT_OF_SCOPE").when(plan, "PLANNED").when(F.col("slots").isNull(), "NO_WORKER").when(F.size(missing) > 0, "NEEDS_INFO").otherwise("CANDIDATE")
    keys = F.when(outside, none).when(plan, F.col("required_slots")).when(F.col("slots").isNull(), none).otherwise(missing)
    return requests.withColumn("status", status).withColumn("keys", keys)


SAVES = "worker_id long, task_id long, seq long, slots map<string,string>"


def save_identity_slots(saves: DataFrame, root: str) -> None:
    """Appends saves (worker_id, task_id, seq, slots) to the audit table below ``root``, which is never rewritten; saves of unknown workers and of none are kept as well."""
    saves.select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in SAVES.split(", ")]).write.mode("append").parquet(f"{root}/identity-saves")


def saved_workers(spark: SparkSession, root: str, workers: DataFrame) -> DataFrame:
    """``workers`` with every save of the audit table laid over their slots, in order of seq; null values are saved as well."""
    saves = spark.read.schema(SAVES).parquet(f"{root}/identity-saves").where("worker_id is not null")
    return upsert_identity_slots(saves.select("worker_id", "seq", F.explode("slots").alias("key", "value")), workers)
