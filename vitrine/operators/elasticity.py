"""Price elasticity: two-arm response lines, uplift of a discount, the best discount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.operators.skew import keyed_join, lookup_join
from vitrine.sources.staging import stage


def elasticity_features(products: DataFrame, category_codes: dict[str, int]) -> DataFrame:
    return products.select(
        "product_id",
        *fixed.ELASTICITY_COLUMNS,
        S.encode(F.col("category"), category_codes).alias("category_encoded"),
    )


def experiment_features(
    experiments: DataFrame, products: DataFrame, category_codes: dict[str, int]
) -> DataFrame:
    """Experiments with their product's features; unknown products are skipped."""
    features = elasticity_features(products, category_codes)
    return keyed_join(numbered(experiments), features, "product_id", unique="row_no").drop("row_no")


def numbered(experiments: DataFrame) -> DataFrame:
    """Experiments with their arm and a number of the row.  Equal rows are many, and the
    number is what spreads those of a hot product; a task that is run again gives the same."""
    return experiments.select(
        "product_id",
        "discount_pct",
        "conversion_rate",
        S.treatment_arm(F.col("discount_pct")).alias("treated"),
        F.monotonically_increasing_id().alias("row_no"),
    )


def response_lines(experiments: DataFrame, products: DataFrame) -> DataFrame:
    """Straight line of conversion over discount, per category and arm."""
    rows = keyed_join(
        numbered(experiments), products.select("product_id", "category"), "product_id", unique="row_no"
    )
    return rows.groupBy("category", "treated").agg(
        F.regr_slope("conversion_rate", "discount_pct").alias("slope"),
        F.regr_intercept("conversion_rate", "discount_pct").alias("intercept"),
        F.count(F.lit(1)).alias("n"),
    )


def lines_by_category(lines: DataFrame) -> DataFrame:
    """The two arms of a category side by side."""
    treated = F.col("treated") == 1
    return lines.groupBy("category").agg(
        F.max(F.when(~treated, F.col("intercept"))).alias("control_intercept"),
        F.max(F.when(treated, F.col("intercept"))).alias("treated_intercept"),
        F.max(F.when(treated, F.col("slope"))).alias("treated_slope"),
    )


def fit_lines(experiments: DataFrame, products: DataFrame) -> DataFrame:
    """The closed-form model: a staged table with both lines of each category."""
    return stage(lines_by_category(response_lines(experiments, products)), "response_lines")


def with_lines(products: DataFrame, model: DataFrame) -> DataFrame:
    """Products with the lines of their category."""
    return lookup_join(products, model, "category", "left")


def closed_form_uplift(discount: Column) -> Column:
    gain = F.col("treated_intercept") + F.col("treated_slope") * discount
    gain = gain - F.col("control_intercept")
    return S.rnd(F.coalesce(F.greatest(F.lit(0.0), gain), F.lit(0.0)), 4)


def discounts() -> Column:
    steps = round(fixed.MAX_DISCOUNT / fixed.DISCOUNT_STEP)
    per_cent = round(fixed.DISCOUNT_STEP * 100)
    return F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: i * per_cent / 100.0)


def discount_grid(products: DataFrame) -> DataFrame:
    return products.withColumn("discount", F.explode(discounts()))


def unit_margin() -> Column:
    price, cost = F.col("current_price"), F.col("cost_price")
    return (price - cost) / (price + 1e-6)


def objective(uplift: Column, discount: Column) -> Column:
    weight = fixed.MARGIN_WEIGHT
    return (1 - weight) * uplift - weight * (discount * unit_margin())


def predict_uplift(products: DataFrame, model: DataFrame) -> DataFrame:
    """Uplift of every product at every discount of the grid."""
    return discount_grid(with_lines(products, model)).withColumn(
        "uplift", closed_form_uplift(F.col("discount"))
    )


def best_of_grid(scored: DataFrame) -> DataFrame:
    """Best discount per product of a grid with an ``uplift`` from any model.

    Of equal scores the lowest discount wins.  Each task keeps one row per product
    before the shuffle.
    """
    score = objective(F.col("uplift"), F.col("discount"))
    best = F.max_by(
        F.struct("discount", "uplift", (F.col("discount") * unit_margin()).alias("loss")),
        F.struct(score, -F.col("discount")),
    )
    return scored.groupBy("product_id").agg(best.alias("best")).select("product_id", *outcome())


def outcome() -> list[Column]:
    return [
        F.col("best.discount").alias("optimal_discount_pct"),
        F.col("best.uplift").alias("expected_uplift"),
        S.rnd(F.col("best.discount") * 0.5, 4).alias("expected_margin_loss"),
        S.rnd(F.col("best.loss"), 4).alias("true_margin_loss"),
    ]


def with_discounts(products: DataFrame, model: DataFrame) -> DataFrame:
    """Products with their best discount under the response lines as columns."""
    options = F.transform(
        discounts(),
        lambda d: F.struct(
            objective(closed_form_uplift(d), d).alias("score"),
            (-d).alias("preference"),
            d.alias("discount"),
            closed_form_uplift(d).alias("uplift"),
            (d * unit_margin()).alias("loss"),
        ),
    )
    best = with_lines(products, model).withColumn("best", F.array_max(options))
    return best.select(*[F.col(f"`{name}`") for name in products.columns], *outcome())


def optimal_discounts(products: DataFrame, model: DataFrame) -> DataFrame:
    """Best discount of every product, without any shuffle."""
    names = ["optimal_discount_pct", "expected_uplift", "expected_margin_loss", "true_margin_loss"]
    return with_discounts(products, model).select("product_id", *names)
