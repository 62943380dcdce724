import pytest
from pyspark.sql import functions as F

from caseflow.llm import components, shared, similar


def _tasks(spark, group, run):
    """What ``run`` returns, and the stages that ran for it."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        found = run()
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(job).stageIds}
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    return found, len([s for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks])


def _chain(spark):
    return shared.materialize(spark.createDataFrame([(i, i + 1) for i in range(6)] + [(20, 21)], "a long, b long"), "few-chain")


def test_a_round_without_hot_nodes_takes_few_stages(spark):
    edges = _chain(spark)
    found, ran = _tasks(spark, "few-rounds", lambda: {r["node"]: r["component"] for r in components.connected_components(edges).collect()})
    assert found == dict.fromkeys(range(7), 0) | {20: 20, 21: 20}
    assert 0 < ran <= 30


@pytest.mark.parametrize("limit", [100_000, 0], ids=["broadcast", "shuffled"])
def test_hot_keys_meet_their_row_whole(spark, monkeypatch, limit):
    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    monkeypatch.setattr(shared, "BROADCAST_KEYS", limit)
    rows = shared.materialize(spark.createDataFrame([(i % 3, i) for i in range(60)] + [(7, 1), (8, None), (None, 2)], "k long, v long"), "few-rows")
    other = shared.materialize(rows.groupBy("k").agg(F.count("*").alias("n")), "few-other")
    wide = rows.withColumn("w", F.col("v") * 2)
    got, ran = _tasks(spark, f"few-hot-{limit}", lambda: shared.spread_join(wide, other, ["k"], "v", 20, counted=rows).select("k", "v", "n", "w").collect())
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, v, 20 if k < 3 else 1, v and v * 2)) for k, v in map(tuple, rows.collect()) if k is not None)
    assert not limit or 0 < ran <= 9


@pytest.mark.parametrize("limit", [100_000, 0], ids=["broadcast", "shuffled"])
def test_links_of_hot_nodes_are_verified_alike(spark, monkeypatch, limit):
    sets = shared.materialize(spark.createDataFrame([(i, list(range(10 + i % 3))) for i in range(30)] + [(30, [99])], "node long, shingles array<long>"), "few-sets")
    pairs = shared.materialize(spark.createDataFrame([(0, i) for i in range(1, 31)] + [(i, 30) for i in range(1, 30)] + [(3, 4), (4, 5)], "a long, b long"), "few-pairs")
    plain = sorted(map(tuple, similar._verified(pairs, sets, 0.9).collect()))
    monkeypatch.setattr(shared, "HOT_ROWS", 2)
    monkeypatch.setattr(shared, "BROADCAST_KEYS", limit)
    assert sorted(map(tuple, similar._verified(pairs, sets, 0.9).collect())) == plain and (3, 4) in plain and (0, 30) not in plain
