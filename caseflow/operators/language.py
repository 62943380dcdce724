"""Notices for workers: bounds of requests and drafts, rendered texts, search queries, checks of candidates, output contracts, generation metrics.

A request has ``request_reason``, ``requested_items`` (array), ``deadline`` and ``submission_method``. Errors are columns, never exceptions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.facts import extract_facts, first_date, let, machine_tokens
from caseflow.functions.text import nfc_strip, strip

#: The columns a trace may keep.
TRACE_COLUMNS = ["run_id", "node_name", "status", "latency_ms", "retry_count", "target_language", "model_revision", "prompt_version", "context_pack_version", "dataset_revision", "reference_ids", "warning_codes"]
#: Bounds of a request's texts and of a draft's.
REQUEST_BOUNDS = {"request_reason": 500, "submission_method": 1000, "worker_id": 128}
OPTIONAL_BOUNDS = {"preferred_language": 32, "nationality_code": 8}
ITEMS, ITEM_LENGTH = 20, 200
DRAFT_BOUNDS, DRAFT_ITEM_LENGTH = {"request_reason": 1000, "submission_method": 2000}, 400
INPUT_KEYS = ["worker_id", "preferred_language", "nationality_code", "request_context"]


def _outside(c: Column, most: int) -> Column:
    return ~F.coalesce(F.length(nfc_strip(c)).between(1, most), F.lit(False))


def clean_items(items: Column) -> Column:
    """Items stripped and in NFC, null ones empty; normalised together, as a character no item holds stays between them."""
    whole = nfc_strip(F.array_join(items, "\x00", ""))
    return F.when(F.size(items) > 0, F.transform(F.split(whole, "\x00", -1), strip)).otherwise(items)


def _items_outside(items: Column, length: int) -> Column:
    clean = clean_items(items)
    fits = F.size(items).between(1, ITEMS) & F.forall(clean, lambda i: F.length(i).between(1, length))
    return ~F.coalesce(fits, F.lit(False))


def _errors(checks: dict[str, Column]) -> Column:
    """The names of the checks that fail, in order."""
    return F.array_compact(F.array(*[F.when(failed, name) for name, failed in checks.items()]))


def project_request(inputs: DataFrame) -> DataFrame:
    """The input's known keys alone; unknown columns go."""
    return inputs.select(*[c for c in INPUT_KEYS if c in inputs.columns])


def validate_requests(requests: DataFrame) -> DataFrame:
    """Adds errors: the fields that are out of bounds, in order; a deadline must be written YYYY-MM-DD and be a day."""
    day = strip(F.col("deadline"))
    no_day = F.when(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(day, "yyyy-MM-dd")).isNull()
    checks = {
        "worker_id": _outside(F.col("worker_id"), REQUEST_BOUNDS["worker_id"]),
        **{c: F.col(c).isNotNull() & _outside(F.col(c), n) for c, n in OPTIONAL_BOUNDS.items()},
        "request_reason": _outside(F.col("request_reason"), REQUEST_BOUNDS["request_reason"]),
        "requested_items": _items_outside(F.col("requested_items"), ITEM_LENGTH),
        "deadline": no_day,
        "submission_method": _outside(F.col("submission_method"), REQUEST_BOUNDS["submission_method"]),
    }
    return requests.withColumn("errors", _errors(checks))


def validate_drafts(drafts: DataFrame) -> DataFrame:
    """Adds errors: the fields of a draft that are out of bounds."""
    checks = {
        "request_reason": _outside(F.col("request_reason"), DRAFT_BOUNDS["request_reason"]),
        "requested_items": _items_outside(F.col("requested_items"), DRAFT_ITEM_LENGTH),
        "submission_method": _outside(F.col("submission_method"), DRAFT_BOUNDS["submission_method"]),
    }
    return drafts.withColumn("errors", _errors(checks))


def validate_vectors(points: DataFrame, *, dims: int) -> DataFrame:
    """Adds errors for dense (length, finite) and sparse (equal lengths, indices not negative, sorted, unique, values finite) vectors."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    idx, values = F.col("indices"), F.col("weights")
    checks = {
        "dense_length": ~F.coalesce(F.size("dense") == dims, F.lit(False)),
        "dense_finite": ~F.coalesce(F.forall("dense", finite), F.lit(False)),
        "sparse_length": ~F.coalesce(F.size(idx) == F.size(values), F.lit(False)),
        "sparse_negative": F.coalesce(F.exists(idx, lambda i: i < 0), F.lit(False)),
        "sparse_order": ~F.coalesce(idx == F.array_sort(idx), F.lit(False)),
        "sparse_unique": F.coalesce(F.size(F.array_distinct(idx)) < F.size(idx), F.lit(False)),
        "sparse_finite": ~F.coalesce(F.forall(values, finite), F.lit(False)),
    }
    return points.withColumn("errors", _errors(checks))


def privacy_projection(traces: DataFrame) -> DataFrame:
    """Traces with the allowed columns alone; any other column is an error of the caller."""
    extra = [c for c in traces.columns if c not in TRACE_COLUMNS]
    if extra:
        raise ValueError(f"columns that no trace may hold: {', '.join(extra)}")
    return traces.select(*[c for c in TRACE_COLUMNS if c in traces.columns])


def check_selected_context(selected: DataFrame) -> DataFrame:
    """Adds error: contexts picked by a reranker need a finite score, those picked by rank fusion must have none."""
    score = F.col("reranker_score")
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))
    error = F.when((F.col("selected_by") == "reranker") & ~finite, "RERANKER_SCORE_REQUIRED").when((F.col("selected_by") == "cross_query_rrf") & score.isNotNull(), "RERANKER_SCORE_FORBIDDEN")
    return selected.withColumn("error", error.when(~F.coalesce(F.col("selected_by").isin("reranker", "cross_query_rrf"), F.lit(False)), "UNKNOWN_SELECTION"))


def check_validation_state(states: DataFrame) -> DataFrame:
    """Adds valid: passed has no checks, failed one failed check or more, inconclusive only inconclusive ones, not_run nothing and no retries."""
    failed, open_ = F.size("failed_checks"), F.size("inconclusive_checks")
    rule = (
        F.when(F.col("status") == "passed", (failed == 0) & (open_ == 0))
        .when(F.col("status") == "failed", failed > 0)
        .when(F.col("status") == "inconclusive", (failed == 0) & (open_ > 0))
        .when(F.col("status") == "not_run", (failed == 0) & (open_ == 0) & (F.col("retry_count") == 0))
    )
    return states.withColumn("valid", F.coalesce(rule, F.lit(False)))


def component_status(outputs: DataFrame, *, text_col: str, warnings_col: str) -> DataFrame:
    """Adds status (no text: failed, any warning: warning, else success) and requires_human_review."""
    status = F.when(F.col(text_col).isNull(), "failed").when(F.coalesce(F.size(warnings_col), F.lit(0)) > 0, "warning").otherwise("success")
    return outputs.withColumn("status", status).withColumn("requires_human_review", F.col("status") != "success")


def merge_warnings(*lists: Column) -> Column:
    """All warnings in order, each once; null lists are empty."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(x, none) for x in lists]))


def combine_checks(hard: Column, semantic: Column) -> Column:
    """Hard checks, then semantic ones, each once."""
    return merge_warnings(hard, semantic)


def check_output_contract(outputs: DataFrame) -> DataFrame:
    """Adds errors: the invariants between the fields of an assistant's output that do not hold, by name.

    Needs standard_status, easy_text, standard_text, easy_warnings, translated_text, translation_status, translation_validation, reference_ids, reference_count,
    generation_status, requires_human_review and warnings.
    """
    fallback = F.array_contains(F.coalesce("easy_warnings", F.array().cast("array<string>")), "EASY_KOREAN_STANDARD_FALLBACK")
    same = F.coalesce(F.col("easy_text") == F.col("standard_text"), F.lit(False))
    none = F.col("translated_text").isNull()
    overall = F.when(F.col("standard_text").isNull(), "failed").when(none | (F.coalesce(F.size("warnings"), F.lit(0)) > 0), "warning").otherwise("success")
    checks = {
        "standard.success": F.coalesce(F.col("standard_status") != "success", F.lit(True)),
        "easy.fallback": same != fallback,
        "translation.missing": none & ~F.coalesce((F.col("translation_status") == "failed") & (F.col("translation_validation") == "not_run"), F.lit(False)),
        "references.count": F.coalesce(F.size("reference_ids") != F.col("reference_count"), F.lit(True)),
        "status.overall": F.coalesce(F.col("generation_status") != overall, F.lit(True)),
        "review.flag": F.coalesce(F.col("requires_human_review") != (F.col("generation_status") != "success"), F.lit(True)),
    }
    return outputs.withColumn("errors", _errors(checks))


def _numbered(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def _listed(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n")


def format_notice(reason: Column, items: Column, deadline: Column, method: Column) -> Column:
    """The standard Korean notice; an ISO date as deadline."""
    lines = [F.lit("다음 요청 내용을 확인해 주세요."), F.lit(""), F.concat(F.lit("요청 목적: "), reason), F.lit("준비할 자료:"), _numbered(items), F.concat(F.lit("제출 기한: "), deadline), F.concat(F.lit("제출 방법: "), method)]
    return F.concat_ws("\n", *lines)


def notice_errors(notice: Column, method: Column, tokens: Column) -> Column:
    """What a rendered notice breaks: the method must stand in it once, every token's surface at least once."""
    times = F.size(F.split(notice, F.concat(F.lit("\\Q제출 방법: "), method, F.lit("\\E")), -1)) - 1
    return F.array_compact(F.array(F.when(times != 1, "submission_method.once"), F.when(F.exists(tokens, lambda t: ~F.contains(notice, t)), "protected_token.missing")))


def render_easy(reason: Column, items: Column, deadline: Column, method: Column) -> Column:
    """An easy Korean draft as text."""
    return F.concat_ws("\n", F.concat(F.lit("신청 사유: "), reason), F.lit("필요한 서류:"), _listed(items), F.concat(F.lit("제출 기한: "), deadline), F.concat(F.lit("제출 방법: "), method))


def render_translation(reason: Column, items: Column, deadline: Column, method: Column) -> Column:
    """A translated draft as text."""
    return F.concat_ws("\n", F.concat(F.lit("Reason: "), reason), F.lit("Requested Items:"), _listed(items), F.concat(F.lit("Deadline: "), deadline), F.concat(F.lit("Submission Method: "), method))


def build_queries(requests: DataFrame) -> DataFrame:
    """(request_id, query_kind, text, error): three search queries for each request, from its texts stripped and in NFC, with the canonical values of tokens that are written otherwise.

    Tokens are those of the reason, of each item, of the deadline and of the method. ``error`` is QUERY_TOKEN_OMITTED where a text lacks one of them as it is written. Null items are left out, as are parts that are null.
    """
    clean = requests.select(
        "request_id", nfc_strip(F.col("request_reason")).alias("reason"), clean_items(F.array_compact("requested_items")).alias("items"), strip(F.col("deadline").cast("string")).alias("day"), nfc_strip(F.col("submission_method")).alias("method")
    )
    tokens = lambda c: extract_facts(F.col(c), clean=True)
    each = F.transform(F.coalesce("items", F.array().cast("array<string>")), lambda i: extract_facts(i, clean=True))
    facts = F.concat(tokens("reason"), F.flatten(each), tokens("day"), tokens("method"))
    rows = clean.withColumn("facts", F.transform(facts, lambda t: F.struct(t["surface"].alias("surface"), t["canonical"].alias("canonical"))))
    other = F.transform(F.filter("facts", lambda t: t["canonical"] != t["surface"]), lambda t: t["canonical"])
    rows = rows.select("*", other.alias("other"), F.array_distinct("facts.surface").alias("surfaces"))
    suffix = F.when(F.size("other") > 0, F.concat(F.lit("; 정규 보호값 "), F.array_join("other", ", "))).otherwise("")
    part = {"요청 목적": F.col("reason"), "자료": F.array_join("items", ", "), "기한": F.col("day"), "방법": F.col("method")}
    orders = {"canonical": ["요청 목적", "자료", "기한", "방법"], "reason_items": ["요청 목적", "자료", "방법", "기한"], "action_deadline": ["기한", "방법", "요청 목적", "자료"]}
    queries = [F.struct(F.lit(kind).alias("query_kind"), F.concat(F.concat_ws("; ", *[F.concat(F.lit(f"{name} "), part[name]) for name in names]), suffix).alias("text")) for kind, names in orders.items()]
    found = rows.select("request_id", "surfaces", F.explode(F.array(*queries)).alias("q"))
    omitted = F.exists("surfaces", lambda s: ~F.col("q.text").contains(s))
    return found.select("request_id", "q.query_kind", "q.text", F.when(omitted, "QUERY_TOKEN_OMITTED").alias("error"))


def build_translation_queries(requests: DataFrame, *, notice_col: str) -> DataFrame:
    """(request_id, query_kind, text): the notice itself, reason with items, method with deadline."""
    texts = {
        "canonical": F.col(notice_col),
        "reason_items": strip(F.concat_ws(" ", "request_reason", F.array_join("requested_items", " "))),
        "action_deadline": strip(F.concat_ws(" ", "submission_method", F.col("deadline").cast("string"))),
    }
    queries = F.array(*[F.struct(F.lit(kind).alias("query_kind"), text.alias("text")) for kind, text in texts.items()])
    return requests.select("request_id", F.explode(queries).alias("q")).select("request_id", "q.query_kind", "q.text")


def check_tokens(pairs: DataFrame) -> DataFrame:
    """(id, missing, added) for rows of (id, source, candidate): whether a machine token of the source is missing from the candidate, or one was added, counted with repeats.

    Tokens are counted before the shuffle, so a text that repeats a number a million times is one row.
    """
    sides = [pairs.select("id", F.explode(machine_tokens(F.col(c))).alias("token"), F.lit(n).alias("n")) for c, n in (("source", 1), ("candidate", -1))]
    spare = sides[0].unionByName(sides[1]).groupBy("id", "token").agg(F.sum("n").alias("n"))
    found = spare.groupBy("id").agg(F.max(F.col("n") > 0).alias("missing"), F.max(F.col("n") < 0).alias("added"))
    return pairs.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("missing", F.lit(False)).alias("missing"), F.coalesce("added", F.lit(False)).alias("added"))


def validate_candidate(pairs: DataFrame) -> DataFrame:
    """(id, failed_checks) in order, for rows of (id, request_reason, requested_items, submission_method, deadline, cand_reason, cand_items, cand_method)."""
    text = lambda *c: F.concat_ws(" ", c[0], F.array_join(c[1], " "), c[2])
    source, candidate = text("request_reason", "requested_items", "submission_method"), text("cand_reason", "cand_items", "cand_method")
    tokens = check_tokens(pairs.select("id", source.alias("source"), candidate.alias("candidate")))
    blank = lambda c: ~F.coalesce(F.col(c), F.lit("")).rlike(r"(?U)\S")
    day = let(candidate, first_date)
    # what the texts tell is settled before the join, so that no text is shuffled
    own = pairs.select("id", blank("cand_reason").alias("r"), blank("cand_method").alias("m"), (F.size("cand_items") != F.size("requested_items")).alias("n"), F.coalesce(day != F.col("deadline"), F.lit(False)).alias("d"))
    checks = {
        "request_reason.present": F.col("r"),
        "submission_method.present": F.col("m"),
        "requested_items.cardinality": F.col("n"),
        "deadline.canonical_value": F.col("d"),
        "machine_tokens.multiset": F.col("missing"),
        "facts.no_addition": F.col("added"),
    }
    return own.join(tokens, "id").select("id", _errors(checks).alias("failed_checks"))


def preservation_rate(cases: DataFrame) -> DataFrame:
    """One row (n, preserved, rate): cases whose output holds the deadline, the expected tokens and all ISO dates and numbers of the source. An empty output fails.

    Needs source (text), deadline (string or null), expected (array or null) and output.
    """
    none = F.array().cast("array<string>")
    dates = F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(r"\d{4}-\d{2}-\d{2}"), F.lit(0))
    numbers = F.regexp_extract_all(F.coalesce("source", F.lit("")), F.lit(r"\b\d+(?:,\d+)*(?:\.\d+)?\b"), F.lit(0))
    tokens = F.array_distinct(F.concat(F.coalesce("expected", none), F.array_compact(F.array("deadline")), dates, numbers))
    held = (F.coalesce("output", F.lit("")) != "") & F.forall(tokens, lambda t: (t == "") | F.contains(F.col("output"), t))
    return cases.agg(F.count("*").alias("n"), F.count_if(held).alias("preserved")).withColumn("rate", F.when(F.col("n") > 0, F.col("preserved") / F.col("n")).otherwise(0.0))


def rubric_means(scores: DataFrame, *, score_col: str = "score", key_col: str = "criterion") -> DataFrame:
    """(criterion, n, mean) over the cases that have a score."""
    return scores.where(F.col(score_col).isNotNull()).groupBy(key_col).agg(F.count("*").alias("n"), F.avg(score_col).alias("mean"))
