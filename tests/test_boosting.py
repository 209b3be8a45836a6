"""Boosters grown in one stage, against those that Spark grows."""

import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from vitrine.functions import boosting as arrays
from vitrine.operators import boosting as B
from vitrine.operators import learners as L
from vitrine.sources.staging import stage

INPUTS = ["a", "b", "c", "d", "same"]


def rows(spark, n, kind="double"):
    table = spark.range(n).selectExpr(
        "id", "rand(1) a", "round(rand(2) * 40) b", "cast(rand(3) * 3 as int) c",
        "if(rand(9) < 0.2, 0, randn(4)) d", "0.0 same", "cast(1 + id % 3 as double) weight",
    )
    y = F.expr("a * 3 + b * 0.1 + c + d * d + randn(7) * 0.3")
    table = stage(table.withColumn("y", y if kind == "double" else (y > 3).cast("double")), "boosting")
    return VectorAssembler(inputCols=INPUTS, outputCol="features").transform(L.dealt(table))


def nodes(spark, model, path):
    model.write().save(path)
    node = F.col("nodeData")
    found = spark.read.parquet(f"{path}/data").select(
        "treeID", node["id"].alias("id"), node["split"].alias("split"), node["rawCount"].alias("n"),
        node["leftChild"].alias("left"), node["prediction"].alias("value"), node["impurityStats"].alias("stats"),
    )
    return found.orderBy("treeID", "id").collect()


# 40,000 rows are three tasks; that many and their sample draw rows one by one, fewer by gaps.
@pytest.mark.parametrize("n, booster, weighted", [
    (3_000, GBTRegressor, False), (3_000, GBTClassifier, True), (20_000, GBTRegressor, True),
    (40_000, GBTRegressor, False),
])
def test_trees_are_those_of_spark(spark, tmp_path, n, booster, weighted):
    given = rows(spark, n, "double" if booster is GBTRegressor else "label")
    options = L.settings("demand", 6, 4) | ({"weightCol": "weight"} if weighted else {})
    learner = booster(labelCol="y", **options)
    theirs, mine = learner.fit(given), B.boosted(learner, given, len(INPUTS))
    assert (mine.getMaxIter(), mine.treeWeights, mine.numFeatures) == (4, theirs.treeWeights, theirs.numFeatures)
    pairs = list(zip(nodes(spark, mine, str(tmp_path / "mine")), nodes(spark, theirs, str(tmp_path / "theirs"))))
    assert len(pairs) == mine.totalNumNodes == theirs.totalNumNodes
    for one, other in pairs:
        assert one[:5] == other[:5]
        assert one.value == pytest.approx(other.value, rel=1e-6, abs=1e-9)
        assert one.stats == pytest.approx(other.stats, rel=1e-6, abs=1e-9)


def test_a_model_is_a_few_jobs(spark):
    """Thirty trees took Spark over two hundred."""
    given = rows(spark, 40_000)
    spark.sparkContext.setJobGroup("boosted", "thirty trees")
    B.boosted(GBTRegressor(labelCol="y", **L.settings("demand", 6, 30)), given, len(INPUTS))
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("boosted")
    spark.sparkContext.setJobGroup("", "")
    assert 0 < len(jobs) < 40


def test_large_blocks_are_added_up_by_pairs_of_features(monkeypatch):
    import numpy as np

    r = np.random.default_rng(3)
    bins = r.integers(0, 9, (5, 3000)).astype(np.uint8)
    edges = [np.arange(8.0)] * 5
    target, taken = r.standard_normal(3000), r.random(3000) < 0.8
    found = []
    for paired in (1 << 15, 1):
        monkeypatch.setattr(arrays, "PAIRED", paired)
        grown = arrays.Rows(bins, edges, np.ones(3000), lambda own: [own])
        grown.begin(target, taken)
        found.append([(n.feature, n.bin, n.stats.round(9).tolist()) for n in arrays.grown(grown, 4)])
    assert found[0] == found[1] and len(found[0]) > 20


def test_without_a_folder_or_rows_spark_decides(spark, monkeypatch):
    given = rows(spark, 500)
    learner = GBTRegressor(labelCol="y", **L.settings("demand", 3, 2))
    with pytest.raises(Exception):
        B.boosted(learner, given.limit(0), len(INPUTS))
    monkeypatch.setattr(B, "meeting_folder", lambda rows: None)
    assert B.boosted(learner, given, len(INPUTS)).getNumTrees == 2


def test_a_missing_label_is_refused(spark):
    given = rows(spark, 500).withColumn("y", F.when(F.col("id") != 7, F.col("y")))
    with pytest.raises(Exception, match="must not be null"):
        B.boosted(GBTRegressor(labelCol="y", **L.settings("demand", 3, 2)), given, len(INPUTS))
