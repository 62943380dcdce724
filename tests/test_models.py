"""Slots for models: isolation, bounded correction, encoding, scoring, retrieval in one call and two-tier labels, with counters, faults and odd rows."""

import math
import re
import sys
from hashlib import md5

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from caseflow.functions.isolation import isolated, once_per_worker, run_isolated, warning_of
from caseflow.operators import correction, encoding, intents, search

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers do not have this module


@pytest.mark.parametrize("n", [0, 1, 2, 7, 64, 1000])
@pytest.mark.parametrize("bad", [lambda i: False, lambda i: i % 7 == 0, lambda i: i == 3, lambda i: True, lambda i: i > 500])
def test_isolation_costs_the_logarithm_of_a_batch(n, bad):
    calls, computed = [], []

    def call(a, b):
        calls.append((a, b))
        for i in range(a, b):
            if bad(i):
                raise KeyError(i)
        computed.extend(range(a, b))
        return [i * i for i in range(a, b)]

    values, faults = run_isolated(call, n)
    assert values == [None if bad(i) else i * i for i in range(n)]
    assert [type(f) for f in faults] == [KeyError if bad(i) else type(None) for i in range(n)]
    assert sorted(computed) == [i for i in range(n) if not bad(i)]  # what passed is not computed again
    n_bad = sum(map(bad, range(n)))
    assert len(calls) <= 1 + n_bad * (math.ceil(math.log2(max(n, 2))) + 2)


def test_isolation_of_wrong_lengths_and_what_is_told():
    values, faults = run_isolated(lambda a, b: [1] * (b - a + (a <= 2 < b)), 5)
    assert values == [1, 1, None, 1, 1] and type(faults[2]) is ValueError
    assert warning_of(KeyError("secret"), "encoder") == {"component": "encoder", "code": "RETRIEVAL_ENCODER_UNAVAILABLE", "message": "KeyError in encoder"}
    assert warning_of(OSError(), "other")["code"] == "RETRIEVAL_UNAVAILABLE" and warning_of(None, "encoder") is None


def test_isolated_columns(spark):
    def inverse(a, b):
        return pd.Series([None if x is None else [1 / x, float(y)] for x, y in zip(a.tolist(), b, strict=True)])

    rows = spark.range(0, 100, 1, 3).select("id", (F.col("id") % 7).alias("v"), F.when(F.col("id") == 5, "x").otherwise("2").alias("t"))
    got = {r["id"]: r["r"] for r in rows.select("id", isolated(inverse, "array<double>", component="retrieval")(F.col("v"), F.col("t")).alias("r")).collect()}
    for i, r in got.items():
        fault = "ZeroDivisionError" if i % 7 == 0 else "ValueError" if i == 5 else None
        assert (r["value"] is None) == (fault is not None) and (r["warning"] and r["warning"]["message"]) == (fault and f"{fault} in retrieval")
    assert rows.limit(0).select(isolated(inverse, "array<double>", component="retrieval")(F.col("v"), F.col("t"))).count() == 0


class Passes:
    """A generator that needs ``need`` attempts for each row, and remembers which rows it was given."""

    def __init__(self):
        self.seen = []

    def generate(self, rows):
        self.seen.append(sorted((r["i"] for r in rows.select("i").collect()), key=str))
        attempt = F.col("attempt")
        error = F.when((F.col("error_at") == attempt), "PROVIDER")
        return rows.withColumns({"generation_error_code": error, "draft": F.when(error.isNull(), F.concat(F.lit("d"), attempt.cast("string")))})

    def check(self, rows):
        return rows.withColumn("hard_failed", F.when(F.col("attempt") < F.col("need"), F.array(F.lit("BAD"))))


def corrected(spark, rows, clock=lambda: 0.0, passes=None, validate=None, retries=2):
    passes = passes or Passes()
    requests = spark.createDataFrame(rows, "i int, need int, error_at int, deadline_seconds double")
    found = correction.bounded_correction(requests, passes.generate, passes.check, validate, clock=clock, retries=retries)
    assert found.columns == [*requests.columns, *correction.RESULT]
    return {r["i"]: r for r in found.collect()}, passes


@pytest.mark.parametrize("retries", [0, 1, 2])
def test_correction_passes_only_what_fails(spark, retries):
    got, passes = corrected(spark, [(i, i, None, 9.0) for i in range(4)], retries=retries)
    assert passes.seen == [list(range(k, 4)) for k in range(retries + 1)]
    for i, r in got.items():
        passed = i <= retries
        assert (r["status"], r["retry_count"], r["draft"]) == ("passed" if passed else "failed", min(i, retries), f"d{min(i, retries)}")
        assert r["failed_checks"] == ([] if passed else ["BAD"]) and r["warnings"] == ([] if passed else ["VALIDATION_RETRY_EXCEEDED"]) and r["requires_human_review"] == (not passed)


def test_correction_ends_when_all_have_passed_and_loses_no_row(spark):
    got, passes = corrected(spark, [(0, 0, None, 9.0), (1, 0, None, 9.0)])
    assert passes.seen == [[0, 1]] and {r["status"] for r in got.values()} == {"passed"}
    found = correction.bounded_correction(spark.createDataFrame([(7, 0, None), (7, 0, None), (None, 5, None)], "i int, need int, error_at int").repartition(2), passes.generate, lambda df: passes.check(df), clock=lambda: 0.0)
    passes.generate = None
    assert sorted((str(r["i"]), r["status"], r["deadline_seconds"]) for r in found.collect()) == [("7", "passed", 120.0), ("7", "passed", 120.0), ("None", "failed", 120.0)]


def test_correction_of_an_empty_table(spark):
    got, passes = corrected(spark, [])
    assert got == {} and passes.seen == [[]]


def test_correction_deadlines_and_failing_generators(spark):
    clock = iter([0.0, 1.0, 2.0])
    rows = [(0, 5, None, 0.0), (1, 5, None, 1.0), (2, 5, None, 2.0), (3, 5, None, 3.0), (4, 0, 0, 9.0), (5, 5, 1, 9.0), (6, 5, 2, 9.0)]
    got, passes = corrected(spark, rows, clock=lambda: next(clock))
    assert passes.seen == [[1, 2, 3, 4, 5, 6], [2, 3, 5, 6], [3, 6]]
    view = {i: (r["status"], r["draft"], r["retry_count"], r["warnings"], r["time_budget_exceeded"], r["generation_error_code"], r["failed_checks"]) for i, r in got.items()}
    late = ["GENERATION_TIME_BUDGET_EXCEEDED"]
    assert view == {
        0: ("failed", None, 0, late, True, None, []), 1: ("failed", "d0", 1, late, True, None, ["BAD"]), 2: ("failed", "d1", 2, late, True, None, ["BAD"]), 3: ("failed", "d2", 2, ["VALIDATION_RETRY_EXCEEDED"], False, None, ["BAD"]),
        4: ("failed", None, 0, [], False, "PROVIDER", []), 5: ("failed", "d0", 1, [], False, "PROVIDER", ["BAD"]), 6: ("failed", "d1", 2, [], False, "PROVIDER", ["BAD"]),
    }


def test_correction_by_a_semantic_validator(spark):
    text = lambda *names: F.array(*map(F.lit, names)).cast("array<string>")

    def validate(rows):
        return rows.withColumns({"semantic_failed": F.when(F.col("i") == 1, text("BAD", "TONE")).otherwise(text()), "semantic_inconclusive": F.when(F.col("i") == 2, text("FACTS")), "unavailable": F.when(F.col("i") == 3, F.col("attempt") == 1)})

    got, _ = corrected(spark, [(0, 0, None, 9.0), (1, 1, None, 9.0), (2, 0, None, 9.0), (3, 3, None, 9.0), (4, 3, 1, 9.0)], validate=validate)
    view = {i: (r["status"], r["failed_checks"], r["inconclusive_checks"], r["warnings"], r["retry_count"]) for i, r in got.items()}
    assert view == {
        0: ("passed", [], [], [], 0), 1: ("failed", ["BAD", "TONE"], [], ["VALIDATION_RETRY_EXCEEDED"], 2), 2: ("inconclusive", [], ["FACTS"], ["VALIDATION_RETRY_EXCEEDED"], 2),
        3: ("inconclusive", ["BAD"], [], ["SEMANTIC_VALIDATION_INCONCLUSIVE"], 1), 4: ("failed", ["BAD"], [], [], 1),
    }


def plain_vector(text, dims=64, size=1 << 20):
    dense, sparse = [0.0] * dims, {}
    words = ["".join(w) for w in re.findall(r"[^\W_]+", (text or "").lower())]
    for w in words:
        h = int(md5(w.encode()).hexdigest()[:15], 16)
        dense[h % dims] += -1 if h // dims % 2 else 1
        sparse[h % size] = sparse.get(h % size, 0) + 1
    return len(words), dense, sorted(sparse), [float(sparse[k]) for k in sorted(sparse)]


def test_encoder_equals_its_plain_twin_over_whole_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", F.lit("mine").alias("encoded"))
    texts = dict(duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall())
    got = encoding.encode_texts(docs, out_col="v", max_tokens=2**31 - 1)
    assert got.columns == ["doc_id", "text", "encoded", "v"]
    for r in got.collect():
        assert (r["v"]["n_tokens"], r["v"]["dense"], r["v"]["sparse_indices"], r["v"]["sparse_values"]) == plain_vector(texts[r["doc_id"]])


class Choosy(encoding.HashingEncoder):
    def token_count(self, text):
        if text == "uncounted":
            raise OSError
        return super().token_count(text)

    def encode(self, texts):
        if "broken" in texts:
            raise RuntimeError
        return super().encode(texts)


def test_encoder_marks_long_texts_and_faults(spark):
    texts = ["a b", "w " * 129, "w " * 128, None, "", "broken", "uncounted", "a b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    got = {r["i"]: r["encoded"] for r in encoding.encode_texts(rows, Choosy, model="choosy").collect()}
    assert [got[i]["error"] for i in range(8)] == [None, "RETRIEVAL_QUERY_TOO_LONG", None, None, None, "RETRIEVAL_ENCODER_UNAVAILABLE", "RETRIEVAL_ENCODER_UNAVAILABLE", None]
    assert [got[i]["n_tokens"] for i in range(8)] == [2, 129, 128, 0, 0, 1, None, 2] and got[0] == got[7] and got[1]["dense"] is None and got[5]["dense"] is None
    assert got[5]["warning"]["message"] == "RuntimeError in encoder" and got[3]["dense"] == [0.0] * 64 and got[3]["sparse_indices"] == []
    assert encoding.encode_texts(rows.limit(0)).count() == 0


def test_models_are_made_once_a_worker():
    made = []
    assert once_per_worker(("test", 1), lambda: made.append(1) or "m") == once_per_worker(("test", 1), lambda: made.append(1) or "n") == "m" and made == [1]


class Fussy(encoding.OverlapScorer):
    def score(self, queries, texts, weights):
        if "broken" in texts:
            raise RuntimeError
        return super().score(queries, texts, weights)


def test_scores_fall_back_by_request(spark):
    rows = [(1, 10, 0, "a b c", "a x", 0.9), (1, 11, 1, "a b c", "a B", 0.8), (2, 20, 0, "q", "broken", 0.9), (2, 21, 1, "q", "q", 0.8), (3, 30, 0, "", "a", 0.9), (3, 31, 1, None, None, 0.8)] + [(4, k, k, "z", "z" if k == 30 else "y", 1.0 / (k + 1)) for k in range(31)]
    pairs = spark.createDataFrame(rows, "request_id int, point_id int, rank int, query_text string, text string, score double").withColumn("weights", F.when(F.col("request_id") == 1, F.create_map(F.lit("b"), F.lit(6.0))))
    scored = encoding.score_candidates(pairs, Fussy, model="fussy")
    got = {(r["request_id"], r["point_id"]): r["reranker_score"] for r in scored.collect()}
    assert got[1, 10] == 1 / 8 and got[1, 11] == 7 / 8 and got[2, 20] is None and got[2, 21] is None and got[3, 30] == got[3, 31] == 0.0 and (4, 30) not in got
    from caseflow.operators.retrieval import rerank_topk

    top = {(r["request_id"], r["rank"]): (r["point_id"], r["selected_by"]) for r in rerank_topk(scored).collect()}
    assert top[1, 0] == (11, "reranker") and top[2, 0] == (20, "cross_query_rrf") and max(k for i, k in top if i == 4) == 4


POINTS = [(1, "red fox jumps", "en"), (2, "blue whale sings", "en"), (3, "red whale", "vi"), (4, "red red fox", "en")]


def index(spark, rows=POINTS):
    encoded = encoding.encode_texts(spark.createDataFrame(rows, "point_id long, text string, target_language string"))
    return encoded.select("point_id", "text", "target_language", F.lit("r1").alias("dataset_revision"), "encoded.dense", "encoded.sparse_indices", "encoded.sparse_values")


def asked(spark, rows):
    requests = spark.createDataFrame([(i, text, lang) for i, lang, text, _ in rows], "request_id long, text string, target_language string")
    queries = spark.createDataFrame([(i, k, t) for i, _, _, of in rows for k, t in of.items()], "request_id long, query_kind string, text string")
    return requests, queries


CONTRACT = search.Contract(expected_rows=4, languages=["en", "vi"], revision="r1", dims=64)


def found(spark, rows, points=None, contract=CONTRACT, **options):
    requests, queries = asked(spark, rows)
    out = search.retrieve(requests, queries, index(spark) if points is None else points, contract, kinds=["full", "head"], **options)
    return {r["request_id"]: ([c["point_id"] for c in r["contexts"]], r["warnings"], r["fallback_used"], r["degraded_components"], sorted({c["selected_by"] for c in r["contexts"]})) for r in out.collect()}


ROWS = [(1, "en", "red fox", {"full": "red fox", "head": "fox"}), (2, "vi", "whale", {"full": "whale"}), (3, "en", "long", {"full": "w " * 129, "head": "red"}), (4, "ko", "red", {"full": "red"}), (5, "en", "none", {})]


def test_retrieval_in_one_call(spark):
    got = found(spark, ROWS)
    assert got[1][0][:2] == [1, 4] and got[1][1:] == ([], False, [], ["reranker"]) and got[2] == ([3], [], False, [], ["reranker"])
    assert got[3] == ([], ["RETRIEVAL_QUERY_TOO_LONG"], True, ["encoder"], []) and got[4] == got[5] == ([], ["RETRIEVAL_NO_MATCH"], True, [], [])
    assert set(got[1][0]) == {1, 2, 4}  # of its language only


@pytest.mark.parametrize(
    "change,code",
    [({"revision": "r2"}, "RETRIEVAL_DATASET_MISMATCH"), ({"dims": 8}, "RETRIEVAL_SCHEMA_MISMATCH"), ({"expected_rows": 5}, "RETRIEVAL_UNAVAILABLE"), ({"languages": ["en", "ko"]}, "RETRIEVAL_UNAVAILABLE")],
)
def test_broken_contracts_end_all_requests(spark, change, code):
    got = found(spark, ROWS[:2], contract=search.Contract(**(CONTRACT.__dict__ | change)))
    assert set(map(str, got.values())) == {str(([], [code], True, ["retrieval_store"], []))}


def test_indexes_that_fail_to_be_read(spark):
    failing = F.udf(lambda v: 1 / 0, "array<double>")
    points = index(spark).withColumn("dense", failing("text"))
    assert found(spark, ROWS[:1], points)[1] == ([], ["RETRIEVAL_UNAVAILABLE"], True, ["retrieval_store"], [])
    late = F.udf(lambda v: 1 / 0, "array<long>")  # passes the contract, fails in the search
    assert found(spark, [ROWS[0], ROWS[2]], index(spark).withColumn("sparse_indices", late("text"))) == {1: ([], ["RETRIEVAL_UNAVAILABLE"], True, ["retrieval_store"], []), 3: ([], ["RETRIEVAL_QUERY_TOO_LONG"], True, ["encoder"], [])}


def test_failing_encoders_and_scorers_degrade_their_requests(spark):
    rows = [(1, "en", "red fox", {"full": "broken"}), (2, "en", "red fox", {"full": "red fox"})]
    got = found(spark, rows, encoder=Choosy, encoder_name="choosy")
    assert got[1] == ([], ["RETRIEVAL_ENCODER_UNAVAILABLE"], True, ["encoder"], []) and got[2][1] == []
    points = index(spark, [*POINTS[:3], (4, "broken", "en")])
    got = found(spark, [(1, "en", "red", {"full": "red fox"}), (2, "vi", "red", {"full": "red"})], points, scorer=Fussy, scorer_name="fussy")
    assert got[1][1:] == (["RERANKER_UNAVAILABLE"], True, ["reranker"], ["cross_query_rrf"]) and got[2][1:] == ([], False, [], ["reranker"])
    assert found(spark, ROWS[:1], scorer=None)[1][4] == ["cross_query_rrf"]


def test_second_classifiers_see_only_their_rows(spark):
    seen, words = [], {"A": ["aa", "ab", "ac", "ad", "ae"], "B": ["zz"]}
    texts = ["aa ab ac ad ae", "aa", "zz", None, "boom"]

    class Scorer(intents.KeywordScorer):
        def probabilities(self, texts):
            if "boom" in texts:
                raise RuntimeError
            return super().probabilities(texts)

    def second(rows):
        seen.extend(r["i"] for r in rows.select("i").collect())
        return rows.withColumns({"second_failed": F.col("i") == 2, "second_labels": F.when(F.col("i") == 1, F.array(F.lit("B")))})

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    first = lambda df: intents.classify(df, lambda: Scorer(words), ["A", "B"], model="test")
    got = {r["i"]: (r["labels"], r["selected_model"], r["degraded"]) for r in intents.hybrid_choose(rows, first, second).collect()}
    assert sorted(seen) == [1, 2, 3, 4]
    assert got == {0: (["A"], "FIRST", False), 1: (["B"], "SECOND", False), 2: (["B"], "FIRST_FALLBACK", True), 3: (["A"], "SECOND", False), 4: (["A"], "SECOND", False)}
    for enabled in (True, False):
        got = {r["i"]: (r["selected_model"], r["degraded"]) for r in intents.hybrid_choose(rows, first, None, second_enabled=enabled).collect()}
        assert got[0] == ("FIRST", False) and got[1] == (("FIRST_FALLBACK", True) if enabled else ("FIRST", False))


def test_equal_vectors_tie_in_dense_search(spark):
    from caseflow.operators.retrieval import dense_topk

    rng = np.random.default_rng(5)
    base = rng.normal(size=(5, 64))
    points = spark.createDataFrame([(i, base[i % 5].tolist()) for i in range(200)], "point_id long, dense array<double>")
    got = dense_topk(points, points.where("point_id < 5").withColumnRenamed("point_id", "request_id"), limit=10).orderBy("request_id", "rank").collect()
    assert [(r["request_id"], r["point_id"]) for r in got] == [(q, q + 5 * k) for q in range(5) for k in range(10)]


@pytest.mark.parametrize("direct", [0, 50_000_000])
@pytest.mark.parametrize("negative", [False, True])
def test_sparse_search_with_bounds_equals_the_whole_join(spark, monkeypatch, negative, direct):
    from pyspark.sql import Window

    from caseflow.operators import retrieval

    monkeypatch.setattr(retrieval, "DIRECT_PAIRS", direct)
    from caseflow.operators.retrieval import sparse_topk

    rng = np.random.default_rng(11)
    rows = {(p, int(min(199, rng.zipf(1.3)))): int(rng.integers(-3 if negative else 1, 9)) for p in range(1500) for _ in range(8)}
    points = spark.createDataFrame([(p, i, w) for (p, i), w in rows.items()], "point_id long, idx long, w long")
    queries = points.where("point_id < 60").withColumnRenamed("point_id", "request_id")
    order = Window.partitionBy("request_id").orderBy(F.desc("score"), "point_id")
    pairs = queries.withColumnRenamed("w", "q").join(points, "idx").groupBy("request_id", "point_id").agg(F.sum(F.col("q") * F.col("w")).alias("score"))
    want = pairs.withColumn("rank", F.row_number().over(order) - 1).where("rank < 10")
    keep = lambda df: sorted(map(tuple, df.select("request_id", "rank", "point_id", "score").collect()))
    assert keep(sparse_topk(points, queries, limit=10)) == keep(want)
    assert sparse_topk(points.limit(0), queries).count() == 0
