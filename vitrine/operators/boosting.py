"""Boosters of ``pyspark.ml`` fitted in one stage.

``booster.fit`` runs a job for each level of each tree, some two thousand for a model, and goes
through all rows in each.  Here the tasks of one barrier stage hold the rows as bytes and grow all
trees (``functions.boosting``).  The model is one of Spark's, read from the files that such a model is
saved as.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.ml.base import Model
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import boosting
from vitrine.sources.staging import session_folder

# Parameters of a booster that its trees have, too.
OF_TREES = {"featuresCol", "labelCol", "weightCol", "maxDepth", "maxBins", "seed"}


def slots(rows: DataFrame) -> int:
    """Tasks that can run side by side: a barrier stage has no more."""
    context = rows.sparkSession.sparkContext._jsc.sc()
    profile = context.resourceProfileManager().defaultResourceProfile()
    return max(1, context.maxNumConcurrentTasks(profile))


def meeting_folder(rows: DataFrame) -> str | None:
    """A folder that tasks open by themselves, if the shared folder is one and a barrier stage can
    be had, which executors that come and go cannot run."""
    spark = rows.sparkSession
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(f"{session_folder(spark)}/boosting-{uuid.uuid4().hex}")
    files = path.getFileSystem(context._jsc.hadoopConfiguration())
    elastic = context.getConf().get("spark.dynamicAllocation.enabled", "false").lower() == "true"
    if elastic or files.getUri().getScheme() != "file":
        return None
    files.mkdirs(path)
    return path.toUri().getPath()


def boosted(booster: GBTRegressor | GBTClassifier, rows: DataFrame, n_features: int) -> Model:
    """What ``booster.fit(rows)`` gives, for rows in at most as many partitions as there are slots."""
    folder = meeting_folder(rows)
    if folder is None:
        return booster.fit(rows)
    weighted = booster.isSet("weightCol")
    settings = boosting.Settings(
        trees=booster.getMaxIter(),
        depth=booster.getMaxDepth(),
        step=booster.getStepSize(),
        share=booster.getSubsamplingRate(),
        seed=booster.getSeed(),
        bins=booster.getMaxBins(),
        logistic=isinstance(booster, GBTClassifier),
    )
    given = rows.select(
        vector_to_array("features").alias("features"),
        F.col(booster.getLabelCol()).cast("double").alias("label"),
        (F.col(booster.getWeightCol()).cast("double") if weighted else F.lit(1.0)).alias("weight"),
    )
    train = boosting.trainer(settings, n_features, weighted, folder)
    spark, path = rows.sparkSession, f"{session_folder(rows.sparkSession)}/booster-{uuid.uuid4().hex}"
    edge = F.when(F.col("edge").isNull(), F.array().cast("array<double>")).otherwise(F.array("edge"))
    split = [F.col("feature").alias("featureIndex"), edge.alias("leftCategoriesOrThreshold")]
    node = [
        "id", "prediction", "impurity", F.col("stats").alias("impurityStats"), F.col("count").alias("rawCount"),
        "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"),
        F.struct(*split, F.lit(-1).alias("numCategories")).alias("split"),
    ]
    nodes = given.mapInArrow(train, boosting.SAVED, barrier=True)
    nodes.select(F.col("tree").alias("treeID"), F.struct(*node).alias("nodeData")).write.parquet(f"{path}/data")
    if spark.read.parquet(f"{path}/data").isEmpty():
        # Spark says what is wrong with no rows at all, and trains where tasks share no folder.
        return booster.fit(rows)
    return model_at(path, booster, n_features, spark)


def model_at(path: str, booster: GBTRegressor | GBTClassifier, n_features: int, spark: SparkSession) -> Model:
    """The model of the nodes that were written to the path, which gets what else Spark reads there."""
    kind = GBTClassificationModel if isinstance(booster, GBTClassifier) else GBTRegressionModel
    package = "classification" if kind is GBTClassificationModel else "regression"
    given = {param.name: value for param, value in booster._paramMap.items()}
    default = {param.name: value for param, value in booster._defaultParamMap.items()}

    def described(name: str, uid: str, **more) -> str:
        about = {"class": f"org.apache.spark.ml.{name}", "timestamp": int(time.time() * 1000)}
        return json.dumps(about | {"sparkVersion": spark.version, "uid": uid} | more)

    of_trees = {name: value for name, value in given.items() if name in OF_TREES}
    trees = []
    for number in range(booster.getMaxIter()):
        uid = f"dtr_{uuid.uuid4().hex[:12]}"
        about = described("regression.DecisionTreeRegressionModel", uid, paramMap=of_trees, defaultParamMap={})
        trees.append((number, about, booster.getStepSize() if number else 1.0))
    about = described(
        f"{package}.{kind.__name__}", booster.uid, paramMap=given, defaultParamMap=default,
        numFeatures=n_features, numTrees=len(trees),
    )
    spark.createDataFrame([(about,)], "value string").coalesce(1).write.text(f"{path}/metadata")
    schema = "_1 int, _2 string, _3 double"
    spark.createDataFrame(trees, schema).coalesce(1).write.parquet(f"{path}/treesMetadata")
    return kind.load(path)
