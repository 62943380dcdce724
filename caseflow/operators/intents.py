"""Two-tier labels: a cheap classifier for all rows, a second one for those it leaves uncertain."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseflow.functions.isolation import once_per_worker, run_isolated
from caseflow.operators.routing import guardrail_route, probability_margin
from caseflow.sources.shared import materialize


class Classifier(Protocol):
    def probabilities(self, texts: Sequence[str]) -> Sequence[dict[str, float]]: ...


class KeywordScorer:
    """A label's probability from the number of its words that a text holds: n / (n + 1). Texts are compared in small letters."""

    def __init__(self, words: dict[str, list[str]]) -> None:
        self.words = words

    def probabilities(self, texts: Sequence[str]) -> list[dict[str, float]]:
        out = []
        for text in texts:
            low = text.lower()
            hits = {label: sum(w in low for w in words) for label, words in self.words.items()}
            out.append({label: n / (n + 1) for label, n in hits.items()})
        return out


def classify(rows: DataFrame, make: Callable[[], Classifier], labels: list[str], *, text_col: str = "text", model: str = "keywords") -> DataFrame:
    """Adds probs (map of ``labels`` to probabilities), margin and picked (the active labels); a text that the classifier fails on has probability 0 everywhere and classifier_failed."""

    @F.pandas_udf("probs array<double>, failed boolean")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        classifier = once_per_worker(("classifier", model), make)
        for batch in batches:
            texts = [t or "" for t in batch]
            found, faults = run_isolated(lambda a, b, texts=texts: [[float(p.get(name, 0.0)) for name in labels] for p in classifier.probabilities(texts[a:b])], len(texts))
            yield pd.DataFrame({"probs": pd.Series([x or [0.0] * len(labels) for x in found], dtype="object"), "failed": [f is not None for f in faults]})

    scored = probability_margin(rows.withColumn("__p", scores(F.col(text_col))), labels=labels, probs_col="__p.probs")
    return scored.withColumn("probs", F.map_from_arrays(F.array(*map(F.lit, labels)), F.col("__p.probs"))).withColumn("classifier_failed", F.col("__p.failed")).drop("__p")


def hybrid_choose(rows: DataFrame, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame] | None, *, second_enabled: bool = True, text_col: str = "text") -> DataFrame:
    """``rows`` with labels, selected_model, degraded, category and should_route.

    ``first`` adds probs, margin and picked to all rows. What the guardrail routes, and nothing else, goes to ``second``, which adds second_labels (array) and second_failed; the first pass is written once,
    so that neither function sees a row twice. A routed row keeps the first labels where the second gives none; where it failed, or where there is no second although it is enabled, the row is degraded.
    """
    routed = materialize(guardrail_route(first(rows), text_col=text_col), "intents-routed")
    own = [*rows.columns, "category", "should_route"]
    done = lambda df, labels, model, degraded: df.select(*own, labels.alias("labels"), model.alias("selected_model"), degraded.alias("degraded"))
    plain = done(routed.where("not should_route"), F.col("picked"), F.lit("FIRST"), F.lit(False))
    sent = routed.where("should_route")
    if second is None:
        rest = done(sent, F.col("picked"), F.lit("FIRST_FALLBACK" if second_enabled else "FIRST"), F.lit(second_enabled))
    else:
        failed = F.coalesce("second_failed", F.lit(False))
        labels = F.when(~failed & (F.coalesce(F.size("second_labels"), F.lit(0)) > 0), F.col("second_labels")).otherwise(F.col("picked"))
        rest = done(second(sent), labels, F.when(failed, "FIRST_FALLBACK").otherwise("SECOND"), failed)
    return plain.unionByName(rest)
