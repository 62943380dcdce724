"""Tables that Spark sizes too low are not broadcast."""

import random

import pytest

from caseflow.llm import shared, similar, simhash


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plan of every table that the operators write, by name."""
    found, write = {}, shared.materialize

    def record(df, name, **options):
        found.setdefault(name, []).append(_plan(df))
        return write(df, name, **options)

    for module in (simhash, similar):
        monkeypatch.setattr(module, "materialize", record)
    return found


def test_signatures_are_not_broadcast(spark, plans):
    rng = random.Random(3)
    words = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(60)]
    docs = spark.createDataFrame([(i, " ".join([*words[:-1], str(i // 2)])) for i in range(12)], "doc_id long, text string")
    last = simhash.near_duplicates(docs)
    assert "BroadcastHashJoin" not in plans["simhash-links"][0] and "SortMergeJoin" in plans["simhash-links"][0]
    assert len({r["fingerprint"] for r in last.collect()}) <= 6


def test_differences_are_not_broadcast(spark, plans):
    sets = shared.materialize(spark.createDataFrame([(i, [*range(20), 100 + i // 2]) for i in range(8)], "node long, shingles array<long>"), "bc-sets")
    live = shared.materialize(spark.createDataFrame([(7, i, i) for i in range(8)], "bucket long, node long, comp long"), "bc-live")
    pairs = similar._difference_pairs(live, sets, 0.8)
    assert "BroadcastHashJoin" not in _plan(pairs)
    assert {(0, 1), (2, 3), (4, 5), (6, 7)} & {tuple(r) for r in pairs.collect()}
