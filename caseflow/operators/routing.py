"""Routing of requests: guardrails, labels and their evidence, the workflow catalog, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.operators.terms import matched_terms

#: Keywords of the guardrail, and its thresholds.
STATUS_WORDS = ["없음", "완료", "이상없", "특이사항", "특이문의"]
ACTION_WORDS = ["배치", "라인", "지시"]
DOCUMENT_WORDS = ["신청서", "서류", "챙겨", "접수", "명단확인"]
MARGIN, LABEL_AT, MOST_LABELS = 0.76, 0.55, 3
#: The labels, and the workflows of an intent.
LABELS = ["WORKER_ONBOARDING", "EXPIRY_RENEWAL", "DOCUMENT_REQUEST", "PAYROLL_EXPLANATION", "WORK_INSTRUCTION", "EMPLOYMENT_CHANGE", "OUT_OF_SCOPE"]
INTENT_WORKFLOWS = {
    "WORKER_ONBOARDING": ["WF-WRK-001"],
    "EXPIRY_RENEWAL": ["WF-STY-001", "WF-STY-EXC-001", "WF-CON-001"],
    "DOCUMENT_REQUEST": ["WF-DOC-001", "WF-ADM-001"],
    "PAYROLL_EXPLANATION": ["WF-PAY-001"],
    "WORK_INSTRUCTION": ["WF-INS-001"],
    "EMPLOYMENT_CHANGE": ["WF-CHG-001"],
}
#: The catalog: id, intent, sensitivity, required slots, context slots.
CATALOG = [
    ("WF-WRK-001", "WORKER_ONBOARDING", "high", ["source_document_id"], []),
    ("WF-STY-001", "EXPIRY_RENEWAL", "high", ["worker_id", "due_at"], ["worker_id", "due_at", "stay_expiry_date", "passport_status", "arc_status"]),
    ("WF-STY-EXC-001", "EXPIRY_RENEWAL", "critical", ["worker_id", "stay_expiry_date", "stay_verification_status"], ["worker_id", "stay_expiry_date", "stay_verification_status", "status_checked_at", "extension_receipt_document_id", "approval_result_document_id", "new_stay_expiry_date", "employment_end_confirmed_at"]),
    ("WF-CON-001", "EXPIRY_RENEWAL", "high", ["worker_id", "due_at"], ["worker_id", "due_at", "contract_end_date"]),
    ("WF-DOC-001", "DOCUMENT_REQUEST", "medium", ["worker_id", "document_type", "due_at", "submission_channel"], ["worker_id"]),
    ("WF-PAY-001", "PAYROLL_EXPLANATION", "high", ["worker_id", "pay_period", "source_document_id"], ["worker_id", "source_document_id"]),
    ("WF-INS-001", "WORK_INSTRUCTION", "medium", ["worker_id", "effective_at", "work_action"], ["worker_id"]),
    ("WF-CHG-001", "EMPLOYMENT_CHANGE", "critical", ["worker_id", "change_type", "incident_at"], ["worker_id"]),
    ("WF-ADM-001", "DOCUMENT_REQUEST", "medium", ["worker_id", "document_type", "due_at"], ["worker_id"]),
]


def catalog(spark) -> DataFrame:
    """(workflow_id, intent, sensitivity, required_slots, context_slots): the built-in catalog, nine rows."""
    return spark.createDataFrame(CATALOG, "workflow_id string, intent string, sensitivity string, required_slots array<string>, context_slots array<string>")


def read_catalog(spark, path: str | None = None) -> DataFrame:
    """The catalog of an exported JSON array (fields as in ``catalog``); without a path the built-in one. Rows without an id are left out, missing lists are empty."""
    if path is None:
        return catalog(spark)
    rows = spark.read.schema("workflow_id string, intent string, sensitivity string, required_slots array<string>, context_slots array<string>").json(path, multiLine=True)
    none = F.array().cast("array<string>")
    return rows.where("workflow_id is not null").withColumns({c: F.coalesce(c, none) for c in ("required_slots", "context_slots")})


def slot_table(workflows: DataFrame, column: str = "required_slots") -> DataFrame:
    """(workflow_id, pos, slot) of a catalog's lists, in their order."""
    return workflows.select("workflow_id", F.posexplode(column).alias("pos", "slot"))


def lookup_workflow(requests: DataFrame, workflows: DataFrame) -> DataFrame:
    """Requests with their catalog row; unknown ids have nulls. A catalog may come from a file, so whether it is broadcast is left to its measured size."""
    return requests.join(workflows, "workflow_id", "left")


def guardrail_route(rows: DataFrame, *, text_col: str = "text", probs_col: str = "probs", margin_col: str = "margin") -> DataFrame:
    """Adds category and should_route, by the first rule that holds: labels at or above the threshold, status words, action words, salary, document words, margin."""
    text = F.replace(F.col(text_col), F.lit(" "), F.lit(""))
    any_of = lambda words: F.greatest(*[F.contains(text, F.lit(w)) for w in words])
    labels = F.size(F.filter(F.map_values(probs_col), lambda p: p >= LABEL_AT))
    actions = sum((F.contains(text, F.lit(w)).cast("int") for w in ACTION_WORDS), F.lit(0))
    salary = F.contains(text, F.lit("급여계좌")) | (F.contains(text, F.lit("급여")) & F.contains(text, F.lit("확인")))
    category = (
        F.when(labels >= MOST_LABELS, "OOD_Label_Count")
        .when(any_of(STATUS_WORDS), "Rule_Status")
        .when(actions >= 2, "Rule_Action")
        .when(salary, "Rule_Salary")
        .when(any_of(DOCUMENT_WORDS), "Rule_Document")
        .when(F.col(margin_col) < MARGIN, "Low_Margin")
        .otherwise("Pass_BERT")
    )
    return rows.withColumn("category", category).withColumn("should_route", F.col("category") != "Pass_BERT")


def probability_margin(rows: DataFrame, *, labels: list[str], probs_col: str = "probs", threshold: float = LABEL_AT) -> DataFrame:
    """Adds margin and picked from an array of probabilities in the order of ``labels``: without any active label the greatest probability less the threshold, and that label;
    else the least active less the greatest inactive one, and the active labels in order."""
    probs, names = F.col(probs_col), F.array(*map(F.lit, labels))
    active, rest = F.filter(probs, lambda p: p >= threshold), F.filter(probs, lambda p: p < threshold)
    margin = F.when(F.size(active) == 0, F.array_max(probs) - threshold).otherwise(F.array_min(active) - F.coalesce(F.array_max(rest), F.lit(0.0)))
    pairs = F.arrays_zip(probs.alias("p"), names.alias("n"))
    picked = F.transform(F.filter(pairs, lambda x: x["p"] >= threshold), lambda x: x["n"])
    best = F.array(F.element_at(names, F.array_position(probs, F.array_max(probs)).cast("int")))
    return rows.withColumn("margin", margin).withColumn("picked", F.when(F.size(active) == 0, best).otherwise(picked))


def primary_label(rows: DataFrame, *, labels_col: str = "labels", scores_col: str = "scores") -> DataFrame:
    """Adds primary and confidence: OUT_OF_SCOPE only if it stands alone, else the label of the highest score, ties to the first; without any score the first label and 0.85."""
    scores, out = F.col(scores_col), F.lit("OUT_OF_SCOPE")
    of = lambda name: F.coalesce(F.try_element_at(scores, name), F.lit(0.0))
    ranked = F.filter(labels_col, lambda x: x != out)
    best = F.aggregate(ranked, F.element_at(ranked, 1), lambda acc, x: F.when(of(x) > of(acc), x).otherwise(acc))
    plain = F.coalesce(F.size(scores), F.lit(0)) <= 0
    primary = F.when(F.size(ranked) > 0, F.when(plain, F.try_element_at(ranked, F.lit(1))).otherwise(best)).otherwise(out)
    sure = F.when(F.coalesce(F.size(labels_col), F.lit(0)) <= 0, 0.0).when(F.size(ranked) == 0, F.coalesce(F.nullif(of(out), F.lit(0.0)), F.lit(0.5))).when(plain, 0.85).otherwise(of(F.col("primary")))
    return rows.withColumn("primary", F.when(F.coalesce(F.size(labels_col), F.lit(0)) > 0, primary).otherwise(out)).withColumn("confidence", sure)


def check_label_evidence(rows: DataFrame, *, text_col: str = "text", intents_col: str = "intents") -> DataFrame:
    """Adds error, the first that holds: no intents, an unknown one, one given twice, evidence for OUT_OF_SCOPE, evidence that is not in the text, OUT_OF_SCOPE beside others. Intents are (intent, evidence)."""
    intents = F.col(intents_col)
    names = F.transform(intents, lambda x: x["intent"])
    known = F.array(*map(F.lit, LABELS))
    outside = F.array_contains(names, "OUT_OF_SCOPE")
    loose = F.exists(intents, lambda x: (x["intent"] != "OUT_OF_SCOPE") & ~F.coalesce((x["evidence"] != "") & F.contains(F.col(text_col), x["evidence"]), F.lit(False)))
    error = (
        F.when(F.coalesce(F.size(intents), F.lit(0)) <= 0, "NO_INTENT")
        .when(F.exists(names, lambda n: n.isNull() | ~F.array_contains(known, n)), "UNSUPPORTED_INTENT")
        .when(F.size(F.array_distinct(names)) < F.size(names), "DUPLICATE_INTENT")
        .when(F.exists(intents, lambda x: (x["intent"] == "OUT_OF_SCOPE") & x["evidence"].isNotNull()), "EVIDENCE_FORBIDDEN")
        .when(loose, "EVIDENCE_NOT_IN_TEXT")
        .when(outside & (F.size(intents) != 1), "OUT_OF_SCOPE_NOT_ALONE")
    )
    return rows.withColumn("error", error)


def expand_constraints(constraints: Column) -> Column:
    """Workflow ids of a list of constraints: an intent stands for its workflows, each id once, in order."""
    known = F.create_map(*[x for k, v in INTENT_WORKFLOWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.array_distinct(F.flatten(F.transform(constraints, lambda c: F.coalesce(F.try_element_at(known, c), F.array(c)))))


def resolve_workflow(requests: DataFrame, workflows: DataFrame, terms: DataFrame, *, defaults: dict[str, str]) -> DataFrame:
    """(request_id, workflow_id) for requests (request_id, intent, constraints, text): among the workflows of the intent, and of those the allowed ones if any is,
    a single one itself, else the one whose terms match most, else the intent's default if it is a candidate, else null. ``terms`` has workflow_id and term."""
    per_intent = workflows.groupBy("intent").agg(F.array_sort(F.collect_list("workflow_id")).alias("all"))
    rows = requests.join(per_intent, "intent", "left").withColumn("all", F.coalesce("all", F.array().cast("array<string>")))
    allowed = F.array_intersect("all", expand_constraints(F.coalesce("constraints", F.array().cast("array<string>"))))
    rows = rows.withColumn("candidates", F.when(F.size(allowed) > 0, allowed).otherwise(F.col("all"))).select("request_id", "intent", "text", "candidates")
    best = best_matches(rows.select(F.col("request_id").alias("text_id"), "text", "candidates"), terms).withColumnRenamed("text_id", "request_id")
    default = F.create_map(*[F.lit(x) for pair in defaults.items() for x in pair])
    fallback = F.try_element_at(default, F.col("intent"))
    found = rows.join(best, "request_id", "left")
    chosen = F.when(F.size("candidates") == 1, F.element_at("candidates", 1)).when(F.col("best").isNotNull(), F.col("best")).when(F.array_contains("candidates", fallback), fallback)
    return found.select("request_id", chosen.alias("workflow_id"))


def best_matches(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """(text_id, best): the workflow with the greatest total length of matched terms, then the earliest match, then the greatest id. ``texts`` may name its candidates."""
    found = matched_terms(texts, terms, key="workflow_id", fold=True)
    if "candidates" in texts.columns:
        found = found.join(texts.select("text_id", "candidates"), "text_id").where(F.array_contains("candidates", F.col("workflow_id")))
    scores = found.groupBy("text_id", "workflow_id").agg(F.sum(F.length("term")).alias("score"), F.min("at").alias("at"))
    return scores.groupBy("text_id").agg(F.max_by("workflow_id", F.struct("score", -F.col("at"), "workflow_id")).alias("best"))


def top_terms(matches: DataFrame, *, limit: int = 10) -> DataFrame:
    """The first terms of each text, longest first, then by alphabet."""
    order = Window.partitionBy("text_id").orderBy(F.desc(F.length("term")), "term")
    return matches.withColumn("at", F.row_number().over(order)).where(F.col("at") <= limit)
