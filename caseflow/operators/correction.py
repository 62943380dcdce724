"""Generate, check and generate again what failed: a bounded number of passes, each over the rows that still fail."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.sources.shared import materialize

#: The bounds of a correction and its warnings.
RETRIES, BUDGET_SECONDS = 2, 120.0
OUT_OF_TIME, OUT_OF_RETRIES, UNSURE = "GENERATION_TIME_BUDGET_EXCEEDED", "VALIDATION_RETRY_EXCEEDED", "SEMANTIC_VALIDATION_INCONCLUSIVE"
CHECKS = "array<string>"
RESULT = ["draft", "status", "retry_count", "failed_checks", "inconclusive_checks", "warnings", "requires_human_review", "time_budget_exceeded", "generation_error_code"]


def _none() -> Column:
    return F.array().cast(CHECKS)


def semantic_validator(decide: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame], DataFrame]:
    """The slot of a semantic validator: ``decide`` adds semantic_failed and semantic_inconclusive (arrays) and unavailable; without one every candidate passes."""
    passed = lambda rows: rows.withColumns({"semantic_failed": _none(), "semantic_inconclusive": _none(), "unavailable": F.lit(False)})
    return decide or passed


def bounded_correction(
    requests: DataFrame,
    generate: Callable[[DataFrame], DataFrame],
    check: Callable[[DataFrame], DataFrame],
    validate: Callable[[DataFrame], DataFrame] | None = None,
    *,
    retries: int = RETRIES,
    budget_seconds: float = BUDGET_SECONDS,
    clock: Callable[[], float] = time.time,
) -> DataFrame:
    """``requests`` with the columns of RESULT: drafts that passed, or the last one and why it did not.

    ``generate`` adds draft and generation_error_code (null if all went well) to the rows of a pass; for corrections they hold attempt, draft and both lists of checks of the pass before.
    ``check`` adds hard_failed (array) and ``validate`` is the semantic slot. A pass takes only rows that neither passed nor ended, is written once, and its rows are never generated
    again. Rows may bring their own deadline_seconds on ``clock``; otherwise it is now and the budget. Whose deadline is over is not generated in that pass and ends with a warning.

    A row ends: passed without failed or inconclusive checks; inconclusive if the validator is unavailable or only inconclusive checks are left; else failed. A generation that fails at the
    first attempt leaves no draft and no warning, one that fails later the draft before. A request is a row: repeated requests are corrected each, and no row is lost.
    """
    validate = semantic_validator(validate)
    if "deadline_seconds" not in requests.columns:
        requests = requests.withColumn("deadline_seconds", F.lit(float(clock() + budget_seconds)))
    own = [c for c in requests.columns if c not in RESULT]
    pending = requests.select(*own).withColumns({"attempt": F.lit(0), "failed_checks": _none(), "inconclusive_checks": _none()})
    ended, waiting = [], None
    for attempt in range(retries + 1):
        over = F.col("deadline_seconds") <= clock()
        if attempt:
            ended.append(_late(waiting.where(over), own))
            pending = waiting.where(~over)
        else:
            first = pending.where(over).withColumns({"draft": F.lit(None), "generation_error_code": F.lit(None).cast("string")})
            pending, late_at_first = pending.where(~over), first
        made = generate(pending)
        if attempt:  # what went wrong leaves the draft before in its place
            made = made.withColumn("draft", F.when(F.col("generation_error_code").isNull(), F.col("draft")).otherwise(F.col("__before")))
        checked = validate(check(made))
        failed_now = F.col("generation_error_code").isNotNull()
        merged = F.array_distinct(F.concat(F.coalesce("hard_failed", _none()), F.coalesce("semantic_failed", _none())))
        checked = checked.withColumns(
            {
                "failed_checks": F.when(failed_now, F.col("failed_checks")).otherwise(merged),
                "inconclusive_checks": F.when(failed_now, F.col("inconclusive_checks")).otherwise(F.coalesce("semantic_inconclusive", _none())),
                "unavailable": ~failed_now & F.coalesce("unavailable", F.lit(False)),
            }
        )
        clean = (F.size("failed_checks") == 0) & (F.size("inconclusive_checks") == 0)
        end = F.when(failed_now, "error").when(F.col("unavailable"), "unavailable").when(clean, "passed").when(F.lit(attempt == retries), "retries")
        done = materialize(checked.select(*own, "draft", "generation_error_code", "attempt", "failed_checks", "inconclusive_checks", end.alias("__end")), f"correction-{attempt}")
        if not attempt:
            ended.append(_late(late_at_first.withColumn("draft", F.lit(None).cast(done.schema["draft"].dataType)), own))
        ended.append(_finished(done.where("__end is not null"), own, attempt))
        waiting = done.where("__end is null").drop("__end", "generation_error_code").withColumns({"attempt": F.lit(attempt + 1), "__before": F.col("draft"), "generation_error_code": F.lit(None).cast("string")})
        if attempt < retries and waiting.isEmpty():
            break
    out = ended[0]
    for part in ended[1:]:
        out = out.unionByName(part)
    return out


def _late(rows: DataFrame, own: list[str]) -> DataFrame:
    """Rows whose time is over before they are generated (again)."""
    return _result(rows, own, F.array(F.lit(OUT_OF_TIME)), late=True)


def _finished(rows: DataFrame, own: list[str], attempt: int) -> DataFrame:
    warnings = F.when(F.col("__end") == "unavailable", F.array(F.lit(UNSURE))).when(F.col("__end") == "retries", F.array(F.lit(OUT_OF_RETRIES))).otherwise(_none())
    return _result(rows, own, warnings, end=F.col("__end"))


def _result(rows: DataFrame, own: list[str], warnings: Column, *, end: Column | None = None, late: bool = False) -> DataFrame:
    end = F.lit("late") if end is None else end
    unsure = (F.size("failed_checks") == 0) & (F.size("inconclusive_checks") > 0)
    status = F.when(end == "passed", "passed").when((end == "unavailable") | unsure, "inconclusive").otherwise("failed")
    found = {
        "draft": F.col("draft"), "status": status, "retry_count": F.col("attempt"), "failed_checks": F.col("failed_checks"), "inconclusive_checks": F.col("inconclusive_checks"), "warnings": warnings,
        "requires_human_review": end != "passed", "time_budget_exceeded": F.lit(late), "generation_error_code": F.col("generation_error_code"),
    }
    return rows.select(*own, *[c.alias(name) for name, c in found.items()])
