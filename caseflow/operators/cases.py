"""Cases: languages, slots, routing of texts, status histories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.routing import best_matches, top_terms
from caseflow.operators.terms import matched_terms

#: Target language, nationality code, legacy alias.
LANGUAGES = [
    ("en", None, None), ("zh-Hans", "CN", None), ("vi", "VN", "vn"), ("th", "TH", None), ("fil", "PH", "ph"), ("id", "ID", None), ("mn", "MN", None), ("si", "LK", "lk"),
    ("ru", "RU", None), ("uz", "UZ", None), ("ky", "KG", "kg"), ("bn", "BD", "bd"), ("ur", "PK", "pk"), ("km", "KH", "kh"), ("tet", "TL", "tl"),
]

#: Statuses that may follow a status.
TRANSITIONS = {
    "DRAFT": ["NEEDS_INFO", "READY_FOR_REVIEW", "WAITING_WORKER", "CANCELLED"],
    "NEEDS_INFO": ["DRAFT", "READY_FOR_REVIEW", "WAITING_WORKER", "IN_PROGRESS", "CANCELLED"],
    "READY_FOR_REVIEW": ["APPROVED", "NEEDS_INFO", "CANCELLED"],
    "APPROVED": ["IN_PROGRESS", "CANCELLED"],
    "IN_PROGRESS": ["WAITING_WORKER", "WAITING_EXTERNAL", "NEEDS_INFO", "COMPLETED", "CANCELLED"],
    "WAITING_WORKER": ["IN_PROGRESS", "NEEDS_INFO", "COMPLETED", "CANCELLED"],
    "WAITING_EXTERNAL": ["IN_PROGRESS", "COMPLETED", "CANCELLED"],
}


def _lookup(pairs: list[tuple[str, str]], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs for x in pair]), key)


def resolve_language(cases: DataFrame, *, preferred: str = "preferred_language", nationality: str = "nationality_code") -> DataFrame:
    """Adds target_language, language_source, language_warning and language_error: preferred, legacy alias, error for other explicit values, nationality, English."""
    from caseflow.functions.text import strip

    explicit = strip(F.col(preferred))
    canonical = _lookup([(c, c) for c, _, _ in LANGUAGES], explicit)
    alias = _lookup([(a, c) for c, _, a in LANGUAGES if a], explicit)
    nation = _lookup([(n, c) for c, n, _ in LANGUAGES if n], F.upper(strip(F.col(nationality))))
    given = F.col(preferred).isNotNull()
    source = F.when(canonical.isNotNull(), "preferred").when(alias.isNotNull(), "legacy_preferred").when(given, None).when(nation.isNotNull(), "nationality").otherwise("default")
    return cases.withColumns(
        {
            "target_language": F.when(given, F.coalesce(canonical, alias)).otherwise(F.coalesce(nation, F.lit("en"))),
            "language_source": source,
            "language_warning": F.when(source == "legacy_preferred", "LANGUAGE_CODE_NORMALIZED").when(source == "nationality", "LANGUAGE_INFERRED_FROM_NATIONALITY").when(source == "default", "LANGUAGE_DEFAULTED_TO_ENGLISH"),
            "language_error": F.when(source.isNull(), "UNSUPPORTED_PREFERRED_LANGUAGE"),
        }
    )


def missing_slots(cases: DataFrame, catalog: DataFrame) -> DataFrame:
    """Adds missing_slots: required keys (in catalog order) that the map ``slots`` does not hold, whatever their values."""
    return cases.join(catalog.select("workflow_id", "required_slots"), "workflow_id", "left").withColumn(
        "missing_slots", F.array_except(F.coalesce("required_slots", F.array().cast("array<string>")), F.map_keys("slots"))
    )


def match_terms(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, term_id, term) for terms (term_id, term) that occur in a text."""
    return matched_terms(texts, terms).select("text_id", "term_id", "term")


def select_terms(matches: DataFrame, *, limit: int = 10) -> DataFrame:
    """The first terms of each text, longest first, then by alphabet."""
    return top_terms(matches, limit=limit)


def route_workflow(texts: DataFrame, terms: DataFrame, *, default: str) -> DataFrame:
    """(text_id, workflow_id): greatest total length of matched terms, then earliest match, then greatest id; the default without a match."""
    best = best_matches(texts.select("text_id", "text"), terms)
    return texts.select("text_id").join(best, "text_id", "left").select("text_id", F.coalesce("best", F.lit(default)).alias("workflow_id"))


def check_transitions(history: DataFrame) -> DataFrame:
    """Adds previous and allowed to (case_id, seq, status): whether the status may follow the one before; first statuses are allowed."""
    order = Window.partitionBy("case_id").orderBy("seq")
    allowed = F.create_map(*[x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    rows = history.withColumn("previous", F.lag("status").over(order))
    return rows.withColumn("allowed", F.col("previous").isNull() | F.coalesce(F.array_contains(F.try_element_at(allowed, F.col("previous")), F.col("status")), F.lit(False)))


def latest_snapshot(saves: DataFrame, *, key: str, version: str) -> DataFrame:
    """The last saved row of each key."""
    order = Window.partitionBy(key).orderBy(F.desc(version))
    return saves.withColumn("__rn", F.row_number().over(order)).where("__rn = 1").drop("__rn")


def merge_resume(stored: DataFrame, update: DataFrame) -> DataFrame:
    """New slots over stored ones, key by key; an empty instruction keeps the stored one."""
    both = stored.select("task_id", F.col("slots").alias("old"), F.col("instruction").alias("before")).join(update, "task_id", "full_outer")
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    merged = F.map_zip_with(F.coalesce("old", none), F.coalesce("slots", none), lambda k, a, b: F.coalesce(b, a))
    return both.select("task_id", merged.alias("slots"), F.coalesce(F.nullif(F.col("instruction"), F.lit("")), F.col("before")).alias("instruction"))


def resume_cases(stored: DataFrame, update: DataFrame) -> DataFrame:
    """(task_id, instruction, slots, documents, worker_id, company_id, intent, workflow_id, ocr_result): stored cases as they go on with an update.

    New slots stand over stored ones, an empty instruction keeps the stored one, documents are the new ones alone, ids fall back to the stored ones; intent, workflow and recognised fields are
    the stored ones. Cases without an update stay as they are, but for their documents; updates of unknown tasks begin a case. Task ids stand once on each side.
    """
    no_map = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    old, new = stored.alias("o"), update.alias("n")
    both = old.join(new, F.col("o.task_id") == F.col("n.task_id"), "full_outer")
    slots = F.map_zip_with(F.coalesce("o.slots", no_map), F.coalesce("n.slots", no_map), lambda k, a, b: F.when(F.map_contains_key(F.coalesce("n.slots", no_map), k), b).otherwise(a))
    text = lambda c: F.coalesce(c, F.lit(""))
    return both.select(
        F.coalesce("n.task_id", "o.task_id").alias("task_id"), text(F.coalesce(F.nullif(F.col("n.instruction"), F.lit("")), F.col("o.instruction"))).alias("instruction"), slots.alias("slots"),
        F.coalesce("n.documents", F.array().cast(update.schema["documents"].dataType)).alias("documents"), F.coalesce("n.worker_id", "o.worker_id").alias("worker_id"), F.coalesce("n.company_id", "o.company_id").alias("company_id"),
        text(F.col("o.intent")).alias("intent"), text(F.col("o.workflow_id")).alias("workflow_id"), F.col("o.ocr_result"),
    )
