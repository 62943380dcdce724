from pyspark.sql import functions as F

from caseflow.llm import mixing
from caseflow.llm.mixing import mix, words

WEIGHTS = {"lang": {"en": 3, "de": 2}, "source": {"s1": 4, "s2": 0}}


def _docs(spark):
    rows = [(i, "w " * (i % 9), ("en", "de", None)[i % 3], None if i % 17 == 0 else f"s{i % 5}") for i in range(400)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def _mixed(docs, **options):
    domain = F.concat(F.lit("d"), F.coalesce(F.length("source"), F.lit(0)) + F.col("doc_id") % 2)
    found = mix(docs, domain=domain, weights=WEIGHTS, tokens=words(), **options)
    return sorted(map(str, found.select("doc_id", "__domain", "__tokens", "__epoch").collect()))


def test_the_tree_of_few_leaves_takes_few_stages(spark):
    docs = mixing.materialize(_docs(spark), "mixing-stages")
    spark.sparkContext.setJobGroup("mixing-stages", "mix")
    try:
        assert _mixed(docs, budget_share=1.25, floor_epochs=1, max_epochs=3)
        tracker = spark.sparkContext.statusTracker()
        stages = {s for job in tracker.getJobIdsForGroup("mixing-stages") for s in tracker.getJobInfo(job).stageIds}
        ran = [s for s in stages if (info := tracker.getStageInfo(s)) and info.numCompletedTasks]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        spark.sparkContext.setLocalProperty("spark.job.description", None)
    assert 0 < len(ran) <= 18


def test_few_and_many_leaves_mix_alike(spark, monkeypatch):
    docs = _docs(spark)
    for options in ({"budget_share": 0.4, "max_epochs": 1}, {"budget_share": 1.25, "floor_epochs": 1, "max_epochs": 3}, {"budget_share": 5.0, "max_epochs": 2}):
        few = _mixed(docs, **options)
        with monkeypatch.context() as patch:
            patch.setattr(mixing, "BROADCAST_LEAVES", 0)
            assert _mixed(docs, **options) == few
