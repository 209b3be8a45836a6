"""Weight presets and A/B assignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S

WEIGHTS = [*fixed.SIGNALS, "diversity"]


def presets(spark: SparkSession) -> DataFrame:
    """The presets, one row each, with a column per weight."""
    rows = [
        F.struct(
            F.lit(preset["name"]).alias("name"),
            F.lit(preset["description"]).alias("description"),
            *[F.lit(preset[weight]).alias(weight) for weight in WEIGHTS],
        )
        for preset in fixed.PRESETS
    ]
    return spark.range(1).select(F.inline(F.array(*rows)))


def preset_listing(spark: SparkSession) -> DataFrame:
    """Presets with their weights as a map."""
    entries = []
    for weight in WEIGHTS:
        key = "diversity_lambda" if weight == "diversity" else weight
        entries += [F.lit(key), F.col(weight)]
    return presets(spark).select("name", "description", F.create_map(*entries).alias("weights"))


def weight_sum() -> Column:
    total = F.lit(0.0)
    for signal in fixed.SIGNALS:
        total = total + F.col(signal)
    return total


def validate_presets(table: DataFrame) -> DataFrame:
    low, high = fixed.WEIGHT_SUM_RANGE
    return table.withColumn("weight_sum", S.rnd(weight_sum(), 6)).withColumn(
        "is_valid", weight_sum().between(low, high)
    )


def known_preset(name: Column) -> Column:
    """The preset itself when it exists, else the default."""
    listed = [preset["name"] for preset in fixed.PRESETS]
    return F.when(name.isin(listed), name).otherwise(fixed.DEFAULT_PRESET)


def join_presets(rows: DataFrame, column: str) -> DataFrame:
    """Attach the weights of the preset named in a column, or of the default.

    The five presets are a constant map in the plan, so there is no join to shuffle.
    """
    entries = []
    for preset in fixed.PRESETS:
        weights = [F.lit(preset[weight]).alias(weight) for weight in WEIGHTS]
        entries += [F.lit(preset["name"]), F.struct(*weights)]
    found = rows.withColumn("preset", known_preset(F.col(column)))
    found = found.withColumn("weights_", F.create_map(*entries)[F.col("preset")])
    # The signal and its weight would share a name.
    names = {weight: weight for weight in WEIGHTS} | {"demand_spike": "demand_spike_weight"}
    return found.withColumns(
        {name: F.col(f"weights_.{weight}") for weight, name in names.items()}
    ).drop("weights_")


def bucket(user_id: Column, experiment: Column) -> Column:
    text = F.concat_ws(":", experiment, user_id.cast("string"))
    return F.pmod(S.hash_number(text), F.lit(100))


def variant(bucket_no: Column) -> Column:
    name = F.lit(fixed.VARIANT_REST)
    for bound, preset in reversed(fixed.VARIANT_BOUNDS):
        name = F.when(bucket_no < bound, preset).otherwise(name)
    return name


def ab_assign(users: DataFrame, experiment: str = fixed.DEFAULT_EXPERIMENT) -> DataFrame:
    label = F.lit(experiment)
    rows = users.select(
        "user_id", label.alias("experiment"), bucket(F.col("user_id"), label).alias("bucket")
    )
    rows = rows.withColumn("variant", variant(F.col("bucket")))
    text = F.format_string(
        "User %s is assigned to the '%s' weight preset", F.col("user_id"), F.col("variant")
    )
    return rows.withColumn("description", text)


def variant_distribution(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("variant").agg(F.count(F.lit(1)).alias("n_users"))


def under_every_preset(rows: DataFrame) -> DataFrame:
    """Repeat each row under each preset."""
    names = F.array(*[F.lit(preset["name"]) for preset in fixed.PRESETS])
    return rows.withColumn("weight_preset", F.explode(names))
