"""The four scorers as gradient-boosted trees of ``pyspark.ml``.

Each trainer returns a fitted pipeline, which saves and loads as usual, and a one-row
table of metrics on the held-out split.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.functions.vectors import propensity_columns
from vitrine.operators import elasticity as E
from vitrine.operators import metrics
from vitrine.operators.boosting import boosted, slots
from vitrine.operators.inventory import inventory_features, pressure
from vitrine.operators.sampling import train_split
from vitrine.sources.staging import stage, together

SEED = 42
TREES = {"propensity": 300, "elasticity": 200, "inventory": 250, "demand": 300}
# Rows of a training task.  All cores share the rows, unless they would have fewer than pay for a task.
LEAST_ROWS = 1 << 14


def settings(name: str, depth: int, trees: int | None) -> dict:
    return {
        "featuresCol": "features",
        "maxDepth": depth,
        "stepSize": 0.05,
        "subsamplingRate": 0.8,
        "maxIter": trees or TREES[name],
        "seed": SEED,
    }


def held_out(rows: DataFrame, key: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows, staged because boosting reads them many times."""
    rows = stage(train_split(rows, key), name)
    return rows.filter("split = 'train'"), rows.filter("split = 'val'")


def dealt(rows: DataFrame) -> DataFrame:
    """Staged rows dealt evenly to the tasks that train on them, wherever their files ended.

    Samples of a tree are drawn by the places of the rows, so a task that is run again must find
    them in the same order: they are dealt by their values and sorted by them.
    """
    cores = min(rows.sparkSession.sparkContext.defaultParallelism, slots(rows))
    tasks = max(1, min(cores, -(-rows.count() // LEAST_ROWS)))
    return rows.repartition(tasks, *rows.columns).sortWithinPartitions(*rows.columns)


def trained(columns: list[str], booster: GBTRegressor, rows: DataFrame) -> PipelineModel:
    """A pipeline of the named columns and the booster, fitted to staged rows."""
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    model = boosted(booster, assembler.transform(dealt(rows)), len(columns))
    return PipelineModel(stages=[assembler, model])


def repeated(rows: DataFrame, inputs: list[str], *measured: Column, name: str) -> DataFrame:
    """One row for all of equal ``inputs``, with their number as ``weight``.

    To trees such rows are one: they take the same path, and their gradients add up.
    """
    counted = rows.groupBy(*inputs).agg(F.count(F.lit(1)).cast("double").alias("weight"), *measured)
    return stage(counted, name)


def standard_scaler(column: str = "raw", output: str = "features") -> StandardScaler:
    return StandardScaler(inputCol=column, outputCol=output, withMean=True, withStd=True)


def scaled_columns(rows: DataFrame, columns: list[str], train: DataFrame) -> DataFrame:
    """Z-scores with the mean and population deviation of the training rows."""
    fitted = train.agg(
        *[F.avg(name).alias(f"{name}_mean") for name in columns],
        *[F.stddev_pop(name).alias(f"{name}_std") for name in columns],
    )
    # The fitted table has one row and travels with it as scalar subqueries.
    stats = fitted.select(F.struct(*fitted.columns)).scalar()
    scaled = {}
    for name in columns:
        spread = stats[f"{name}_std"]
        usable = F.when(spread == 0, 1.0).otherwise(spread)
        scaled[name] = (F.col(name) - stats[f"{name}_mean"]) / usable
    return rows.withColumns(scaled)


def train_propensity(
    pairs: DataFrame, columns: list[str], trees: int | None = None
) -> tuple[PipelineModel, DataFrame]:
    """``pairs`` as made by ``training_pairs``."""
    train, val = held_out(pairs, F.col("event_id"), "propensity_pairs")
    assembler = VectorAssembler(inputCols=columns, outputCol="raw")
    scaler = standard_scaler().fit(assembler.transform(train))
    # A user meets a product many times.
    pairs = dealt(repeated(train, [*columns, "label"], name="propensity_inputs"))
    booster = GBTClassifier(labelCol="label", weightCol="weight", **settings("propensity", 6, trees))
    fitted = boosted(booster, scaler.transform(assembler.transform(pairs)), len(columns))
    model = PipelineModel(stages=[assembler, scaler, fitted])
    scored = with_propensity(val, model)
    n_train = train.agg(F.count(F.lit(1))).scalar()
    result = metrics.auc(scored, "propensity_score", "label").select(
        S.rnd(F.col("auc"), 4).alias("val_auc"),
        n_train.alias("n_train"),
        (F.col("n_positive") + F.col("n_negative")).alias("n_val"),
    )
    return model, result


def with_propensity(rows: DataFrame, model: PipelineModel) -> DataFrame:
    kept = rows.columns
    scored = model.transform(rows)
    score = vector_to_array("probability")[1]
    return scored.select(*kept, score.alias("propensity_score"))


def propensity_scorer(model: PipelineModel, users: DataFrame, category_codes: dict[str, int]):
    """A scorer for ``recommend`` and ``score_pairs``."""
    columns = propensity_columns(users, category_codes)

    def score(pairs: DataFrame) -> DataFrame:
        kept = pairs.columns
        # Inputs get names of their own, since a pair already has columns of these names.
        inputs = pairs.select(
            "*", *[F.coalesce(c, F.lit(0.0)).alias(f"in_{name}") for name, c in columns.items()]
        )
        assembler = VectorAssembler(inputCols=[f"in_{n}" for n in columns], outputCol="raw")
        scored = PipelineModel(stages=[assembler, *model.stages[1:]]).transform(inputs)
        value = vector_to_array("probability")[1]
        return scored.select(*kept, value.alias("propensity_score"))

    return score


ELASTICITY_INPUT = [*fixed.ELASTICITY_COLUMNS, "category_encoded", "discount_pct"]


def train_elasticity(
    experiments: DataFrame,
    products: DataFrame,
    category_codes: dict[str, int],
    trees: int | None = None,
) -> tuple[PipelineModel, PipelineModel, DataFrame]:
    """One model for small discounts and one for the others."""
    rows = E.experiment_features(experiments, products, category_codes)
    key = F.concat_ws(":", "product_id", "discount_pct", "conversion_rate")
    train, val = held_out(rows, key, "experiments")

    def fit(arm: int) -> PipelineModel:
        # A product has many experiments at one discount; least squares needs their mean alone.
        mean = F.avg("conversion_rate").alias("conversion_rate")
        arm_rows = train.filter(F.col("treated") == arm)
        inputs = repeated(arm_rows, ELASTICITY_INPUT, mean, name=f"experiment_inputs_{arm}")
        booster = GBTRegressor(
            labelCol="conversion_rate", weightCol="weight", **settings("elasticity", 5, trees)
        )
        return trained(ELASTICITY_INPUT, booster, inputs)

    # The arms share nothing, and each is many short jobs.
    fitted = together(rows.sparkSession, control=lambda: fit(0), treated=lambda: fit(1))
    models = [fitted["control"], fitted["treated"]]
    errors = []
    for arm, model in enumerate(models):
        scored = model.transform(val.filter(F.col("treated") == arm))
        mse = metrics.regression_metrics(scored, F.col("conversion_rate"), F.col("prediction"))
        errors.append(S.rnd(mse.select("mse").scalar(), 6))
    one = rows.sparkSession.range(1)
    table = one.select(errors[0].alias("mse_control"), errors[1].alias("mse_treated"))
    return models[0], models[1], table


def grid_uplift(
    products: DataFrame,
    control: PipelineModel,
    treated: PipelineModel,
    category_codes: dict[str, int],
) -> DataFrame:
    """Uplift of every product at every discount under the two models."""
    features = products.withColumn(
        "category_encoded", S.encode(F.col("category"), category_codes)
    )
    base = control.transform(features.withColumn("discount_pct", F.lit(0.0))).select(
        *features.columns, F.col("prediction").alias("at_full_price")
    )
    grid = E.discount_grid(base).withColumn("discount_pct", F.col("discount"))
    gain = F.greatest(F.lit(0.0), F.col("prediction") - F.col("at_full_price"))
    return treated.transform(grid).select(
        *products.columns, "discount", S.rnd(gain, 4).alias("uplift")
    )


def train_inventory(
    products: DataFrame, category_codes: dict[str, int], trees: int | None = None
) -> tuple[PipelineModel, DataFrame]:
    rows = inventory_features(products, category_codes).withColumn("target", pressure())
    train, val = held_out(rows, F.col("product_id"), "inventory")
    booster = GBTRegressor(labelCol="target", **settings("inventory", 5, trees))
    model = trained(fixed.INVENTORY_COLUMNS, booster, train)
    scored = model.transform(val).select(
        "target",
        S.clip(F.col("prediction"), 0.0, 1.0).alias("predicted"),
        (F.col("target") > fixed.BADGE_THRESHOLD).cast("int").alias("label"),
    )
    mse = metrics.regression_metrics(scored, F.col("target"), F.col("predicted"))
    table = metrics.auc(scored, "predicted", "label").select(
        S.rnd(mse.select("mse").scalar(), 6).alias("val_mse"),
        S.rnd(F.col("auc"), 4).alias("val_auc_threshold"),
    )
    return model, table


def model_pressure(
    products: DataFrame, model: PipelineModel, category_codes: dict[str, int]
) -> DataFrame:
    scored = model.transform(inventory_features(products, category_codes))
    return scored.select(
        "product_id", S.clip(F.col("prediction"), 0.0, 1.0).alias("inventory_pressure")
    )


def train_demand(
    training_set: DataFrame, trees: int | None = None
) -> tuple[PipelineModel | None, DataFrame]:
    """Under 100 samples nothing is trained and the model is None."""
    key = F.concat_ws(":", "product_id", "sale_day")
    train, val = held_out(training_set, key, "demand_days")
    if train.count() + val.count() < fixed.MIN_DEMAND_SAMPLES:
        nothing = train.sparkSession.range(1)
        return None, nothing.select(
            F.lit(0.0).alias("mae"), F.lit(0.0).alias("rmse"), F.lit(0).cast("bigint").alias("n_samples")
        )
    booster = GBTRegressor(labelCol="target_demand_7d", **settings("demand", 6, trees))
    model = trained(fixed.DEMAND_COLUMNS, booster, train)
    predicted = F.greatest(F.col("prediction"), F.lit(0.0))
    errors = metrics.regression_metrics(
        model.transform(val), F.col("target_demand_7d"), predicted
    )
    n_train = train.agg(F.count(F.lit(1))).scalar()
    return model, errors.select(
        S.rnd(F.col("mae"), 4).alias("mae"),
        S.rnd(F.col("rmse"), 4).alias("rmse"),
        n_train.alias("n_samples"),
    )


def model_demand(latest: DataFrame, model: PipelineModel) -> DataFrame:
    return model.transform(latest).select(
        "product_id", F.greatest(F.col("prediction"), F.lit(0.0)).alias("predicted_demand")
    )


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)
