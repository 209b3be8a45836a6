"""The registered queries.  Each takes a session and a folder of tables.

A query builds what it needs from the tables through ``Store`` and shows the result of
one operator with doubles rounded, so that it can be compared with SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vitrine import fixed
from vitrine.functions import scalars as S
from vitrine.functions import vectors as V
from vitrine.operators import demand as D
from vitrine.operators import diversity, drift, forest, inventory, metrics, profiles, runs, sampling, threshold
from vitrine.operators import elasticity as E
from vitrine.operators import experiments as X
from vitrine.operators import features as U
from vitrine.operators import learners as L
from vitrine.operators import propensity as P
from vitrine.operators import ranking as R
from vitrine.operators.skew import keyed_join, lookup_join
from vitrine.sources import feature_store, model_store, runlog, staging, tables
from vitrine.streaming import serving

CODES = fixed.PART_TYPE_CODES
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
FITTED: dict[tuple[str, str, str], tuple] = {}


def query(function: Callable[["Store"], DataFrame]) -> Callable[["Store"], DataFrame]:
    QUERIES[function.__name__] = lambda spark, folder: function(Store(spark, folder))
    return function


class Store:
    """The tables of one folder and the features made from them.

    Tables that several steps of a query read, or whose size decides a join, are staged
    when they are first used.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.staged: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return tables.read(self.spark, self.folder, name)

    @property
    def users(self) -> DataFrame:
        return tables.users(self.spark, self.folder)

    @property
    def products(self) -> DataFrame:
        return tables.products(self.spark, self.folder)

    @property
    def ship(self) -> DataFrame:
        return tables.ship_events(self.spark, self.folder)

    @property
    def shipments(self) -> DataFrame:
        return tables.shipments(self.spark, self.folder)

    @property
    def web(self) -> DataFrame:
        return tables.web_events(self.spark, self.folder)

    @property
    def experiments(self) -> DataFrame:
        return tables.experiments(self.spark, self.folder)

    @property
    def requests(self) -> DataFrame:
        return tables.requests(self.spark, self.folder)

    @property
    def ship_as_of(self) -> Column:
        return tables.newest(self.table("lineitem"), "l_shipdate")

    def need(self, *names: str) -> dict[str, DataFrame]:
        """Stage the named tables, side by side, unless they are staged already."""
        make = {
            "users": lambda: self.users,
            "segments": lambda: tables.segments(self.spark, self.folder),
            "products": lambda: self.products,
            "daily": lambda: D.daily_demand(self.shipments),
        }
        missing = [name for name in names if name not in self.staged]
        steps = {n: lambda n=n: staging.stage(make[n](), n) for n in missing}
        self.staged.update(staging.together(self.spark, **steps))
        return self.staged

    @property
    def staged_users(self) -> DataFrame:
        return self.need("users")["users"]

    @property
    def segments(self) -> DataFrame:
        """The part of the users that the default scorer reads."""
        return self.need("segments")["segments"]

    @property
    def staged_products(self) -> DataFrame:
        return self.need("products")["products"]

    @property
    def daily(self) -> DataFrame:
        return self.need("daily")["daily"]

    @property
    def latest(self) -> DataFrame:
        self.need("products", "daily")
        return D.latest_features(self.daily, self.staged_products, CODES)

    @property
    def spikes(self) -> DataFrame:
        self.need("products", "daily")
        return D.closed_form_spikes(self.daily, self.staged_products)

    @property
    def pressure(self) -> DataFrame:
        return inventory.inventory_pressure(self.staged_products, CODES)

    @cached_property
    def lines(self) -> DataFrame:
        return E.response_lines(self.experiments, self.staged_products)

    @cached_property
    def line_model(self) -> DataFrame:
        return E.fit_lines(self.experiments, self.staged_products)

    @cached_property
    def rate_model(self) -> DataFrame:
        self.need("segments", "products")
        return P.fit_rates(self.web, self.segments, self.staged_products)

    @cached_property
    def training_pairs(self) -> DataFrame:
        self.need("users", "products")
        pairs = P.training_pairs(self.web, self.staged_users, self.staged_products, CODES)
        return staging.stage(pairs, "training_pairs")

    def feature_table(self, name: str) -> str:
        """The published feature table of users or products, built once for a folder and
        session."""
        key = self.spark.sparkContext.applicationId, self.folder, f"features_{name}"
        if key not in FITTED:
            made = {
                "users": lambda: U.user_features(self.users, self.ship, self.ship_as_of),
                "products": lambda: U.product_features(self.products, CODES),
            }
            table = f"features_{name}_{staging.uuid.uuid4().hex}"
            path = f"{staging.session_folder(self.spark)}/{table}"
            feature_store.publish(made[name](), f"{name[:-1]}_id", path, table)
            FITTED[key] = (table,)
        return FITTED[key][0]

    def fitted(self, name: str) -> tuple:
        """Trained models and their metrics.  Trained once for a folder and session, since
        several queries score with them."""
        key = self.spark.sparkContext.applicationId, self.folder, name
        if key not in FITTED:
            FITTED[key] = getattr(self, f"_fit_{name}")()
        return FITTED[key]

    def _fit_propensity(self) -> tuple:
        columns = list(V.propensity_columns(self.staged_users, CODES))
        model, table = L.train_propensity(self.training_pairs, columns)
        return model, staging.stage(table, "propensity_metrics")

    def _fit_elasticity(self) -> tuple:
        control, treated, table = L.train_elasticity(self.experiments, self.staged_products, CODES)
        return control, treated, staging.stage(table, "elasticity_metrics")

    def _fit_inventory(self) -> tuple:
        model, table = L.train_inventory(self.staged_products, CODES)
        return model, staging.stage(table, "inventory_metrics")

    def _fit_demand(self) -> tuple:
        self.need("products", "daily")
        model, table = L.train_demand(D.training_set(self.daily, self.staged_products, CODES))
        return model, staging.stage(table, "demand_metrics")

    @property
    def discounts(self) -> DataFrame:
        return E.optimal_discounts(self.staged_products, self.line_model)

    @cached_property
    def catalogue(self) -> DataFrame:
        """Everything ranking needs of the products.  Its parts do not depend on each other."""
        products = self.need("segments", "products", "daily")["products"]
        parts = staging.together(
            self.spark,
            spikes=lambda: staging.stage(self.spikes, "spikes"),
            positions=lambda: staging.stage(R.positions(products), "positions"),
            lines=lambda: self.line_model,
            rates=lambda: self.rate_model,
        )
        priced = E.with_discounts(inventory.with_pressure(products, CODES), parts["lines"])
        scored = R.product_scores(priced, None, parts["spikes"], None, parts["rates"])
        return R.catalogue(scored, parts["positions"])

    def request_all(self, **options) -> DataFrame:
        """One request per user, with the defaults where nothing else is said."""
        wanted = {
            "top_k": fixed.TOP_K[0],
            "candidate_pool": fixed.CANDIDATE_POOL[0],
            "weight_preset": fixed.DEFAULT_PRESET,
            "apply_diversity": True,
            **options,
        }
        return self.table("customer").select(
            F.col("c_custkey").alias("request_id"),
            F.col("c_custkey").alias("user_id"),
            *[
                (value if isinstance(value, Column) else F.lit(value)).alias(name)
                for name, value in wanted.items()
            ],
        )


def ranked_for(s: Store, requests: DataFrame) -> DataFrame:
    catalogue = s.catalogue
    return R.recommend(requests, s.segments, catalogue)


def rounded(table: DataFrame, places: int = 6) -> DataFrame:
    """Round the doubles of a result for display."""
    return table.select(
        *[
            S.rnd(F.col(name), places).alias(name) if kind == "double" else F.col(name)
            for name, kind in table.dtypes
        ]
    )


def whole(*names: str) -> list[Column]:
    return [F.col(name).cast("bigint").alias(name) for name in names]


def spread(table: DataFrame, vector: str, prefix: str, length: int) -> list[Column]:
    return [S.rnd(F.col(vector)[i], 4).alias(f"{prefix}{i:02d}") for i in range(length)]


# Sources


@query
def load_tables(s: Store) -> DataFrame:
    parts = [
        table.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        for name, table in tables.load_tables(s.spark, s.folder).items()
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


@query
def users_view(s: Store) -> DataFrame:
    return rounded(s.users, 4)


@query
def products_view(s: Store) -> DataFrame:
    return rounded(s.products, 4)


@query
def events_view(s: Store) -> DataFrame:
    return rounded(tables.events(s.spark, s.folder), 4)


@query
def experiments_view(s: Store) -> DataFrame:
    return rounded(s.experiments)


def run_base(s: Store) -> DataFrame:
    """Runs derived from the lines: one per ship year, return flag and line status."""
    return (
        s.table("lineitem")
        .groupBy(F.year("l_shipdate").alias("ship_year"), "l_returnflag", "l_linestatus")
        .agg(
            F.count(F.lit(1)).alias("n_lines"),
            S.rnd(F.avg("l_discount"), 6).alias("mean_discount"),
            S.rnd(F.avg("l_quantity"), 6).alias("mean_quantity"),
            F.min("l_shipdate").alias("start_time"),
            F.max("l_shipdate").alias("end_time"),
        )
        .withColumns(
            {
                "experiment": F.concat(F.lit("status_"), "l_linestatus"),
                "run_name": F.concat_ws("_", "l_returnflag", "ship_year"),
            }
        )
    )


def run_entries(base: DataFrame) -> DataFrame:
    """Log entries of the runs.  The discount is logged twice; the later value counts."""
    entries = [
        ("params", "return_flag", F.col("l_returnflag"), 0),
        ("params", "ship_year", F.col("ship_year").cast("string"), 0),
        ("metrics", "n_lines", F.col("n_lines").cast("double").cast("string"), 0),
        ("metrics", "mean_discount", F.lit("0.0"), 0),
        ("metrics", "mean_discount", F.col("mean_discount").cast("string"), 1),
        ("tags", "summary", F.concat(F.lit("lines of "), "run_name"), 0),
    ]
    late = F.col("ship_year") >= 1998
    entries.append(
        ("metrics", "mean_quantity", F.when(late, F.col("mean_quantity").cast("string")), 0)
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(kind).alias("kind"),
                F.lit(key).alias("key"),
                value.alias("value"),
                F.lit(seq).alias("seq"),
            )
            for kind, key, value, seq in entries
        ]
    )
    return base.select("experiment", "run_name", F.inline(rows)).filter("value is not null")


def logged_runs(s: Store) -> DataFrame:
    base = staging.stage(run_base(s), "run_base")
    return runs.log_runs(
        base.select("experiment", "run_name", "start_time", "end_time"), run_entries(base)
    )


def flat_maps(table: DataFrame) -> DataFrame:
    """One row per map entry."""

    def entries(kind: str) -> Column:
        def row(entry: Column) -> Column:
            value, is_number = entry["value"], kind == "metrics"
            return F.struct(
                F.lit(kind).alias("kind"),
                entry["key"].alias("key"),
                (S.rnd(value, 4) if is_number else F.lit(None).cast("double")).alias("number"),
                (F.lit(None).cast("string") if is_number else value).alias("text"),
            )

        return F.transform(F.map_entries(kind), row)

    parts = F.concat(*[entries(kind) for kind in runs.MAP_TYPES])
    return table.select("experiment", "run_name", F.inline(parts))


def write_and_read(s: Store) -> DataFrame:
    path = f"{staging.shared_folder(s.spark)}/runs-{staging.uuid.uuid4().hex}"
    logged = logged_runs(s)
    times = {
        name: F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss") for name in ("start_time", "end_time")
    }
    runlog.write_runs(logged.withColumns(times), path)
    return runlog.read_runs(s.spark, path)


@query
def write_runs(s: Store) -> DataFrame:
    return write_and_read(s).select("experiment", "run_name", "start_time", "end_time")


@query
def read_runs(s: Store) -> DataFrame:
    """The runs as written, and a damaged line as a row that keeps its text."""
    path = f"{staging.session_folder(s.spark)}/runs-{staging.uuid.uuid4().hex}"
    runlog.write_runs(logged_runs(s), path)
    # One line of the log of each experiment is cut off in the middle.
    names = s.table("lineitem").select(F.concat(F.lit("status_"), "l_linestatus").alias("experiment"))
    cut = F.concat(F.lit('{"run_name": "cut_'), "experiment", F.lit('", "params": {"a'))
    names.distinct().select("experiment", cut.alias("value")).write.mode("append").partitionBy(
        "experiment"
    ).text(path)
    read = runlog.read_runs(s.spark, path)
    damaged = read.filter("corrupt_record is not null").select(
        "experiment",
        "run_name",
        F.lit("corrupt").alias("kind"),
        F.lit(None).cast("string").alias("key"),
        F.lit(None).cast("double").alias("number"),
        F.col("corrupt_record").alias("text"),
    )
    return flat_maps(read.filter("corrupt_record is null")).unionByName(damaged)


@query
def feature_tables(s: Store) -> DataFrame:
    counts = []
    for name, key, value in (("users", "user_id", "avg_price_paid"), ("products", "product_id", "margin_score")):
        published = s.spark.table(s.feature_table(name))
        counts.append(
            published.select(
                F.lit(name).alias("store"), F.col(key).alias("id"), S.rnd(F.col(value), 4).alias("value")
            )
        )
    return counts[0].unionByName(counts[1])


# Trees of the models that are saved and loaded; how many there are does not matter to that.
SAVED_TREES = 3


@query
def save_load_model(s: Store) -> DataFrame:
    """All four models and the demand baseline published, read back, and every row scored
    with both: rows and rows that differ, for each model."""
    s.need("users", "products", "daily")
    products, pairs = s.staged_products, s.training_pairs
    columns = list(V.propensity_columns(s.staged_users, CODES))
    fitted = staging.together(
        s.spark,
        propensity=lambda: L.train_propensity(pairs, columns, SAVED_TREES)[0],
        elasticity=lambda: L.train_elasticity(s.experiments, products, CODES, SAVED_TREES)[:2],
        inventory=lambda: L.train_inventory(products, CODES, SAVED_TREES)[0],
        demand=lambda: L.train_demand(D.training_set(s.daily, products, CODES), SAVED_TREES)[0],
    )
    models = {
        "propensity": fitted["propensity"],
        "control": fitted["elasticity"][0],
        "treated": fitted["elasticity"][1],
        "inventory": fitted["inventory"],
    }
    if fitted["demand"]:
        models["demand"] = fitted["demand"]
    path = f"{staging.session_folder(s.spark)}/models-{staging.uuid.uuid4().hex}"
    store = model_store.Store(s.spark, path)
    baseline = D.demand_baseline(s.daily)
    store.publish(models, baseline=baseline)
    loaded, kept = store.read()

    def scores(m: dict, baseline: DataFrame) -> DataFrame:
        uplift = L.grid_uplift(products, m["control"], m["treated"], CODES)
        predicted = L.model_demand(s.latest, m["demand"]) if "demand" in m else D.predict_closed_form(s.latest)
        parts = {
            "propensity": L.with_propensity(pairs, m["propensity"]).select("event_id", "propensity_score"),
            "elasticity": uplift.groupBy("product_id").agg(F.sum("uplift")),
            "inventory": L.model_pressure(products, m["inventory"], CODES),
            "demand": D.demand_spikes(predicted, baseline, products),
        }
        tables = [t.toDF("id", "score").select(F.lit(name).alias("model"), "id", "score") for name, t in parts.items()]
        return tables[0].unionAll(tables[1]).unionAll(tables[2]).unionAll(tables[3])

    after = scores(loaded, kept["baseline"]).withColumnRenamed("score", "loaded_score")
    same = S.rnd(F.col("score"), 9).eqNullSafe(S.rnd(F.col("loaded_score"), 9))
    return scores(models, baseline).join(after, ["model", "id"]).groupBy("model").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(~same).alias("n_different")
    )


# Projections and scalar rules


@query
def sell_through_rate(s: Store) -> DataFrame:
    return s.products.select("product_id", "sell_through_rate")


@query
def margin_score(s: Store) -> DataFrame:
    return s.products.select("product_id", "margin_score")


@query
def affinity_boost(s: Store) -> DataFrame:
    users = s.users
    return rounded(users.select("user_id", "preferred_category", *V.affinity_columns(users)))


@query
def segment_encode(s: Store) -> DataFrame:
    customer = s.table("customer")
    segment = tables.relabel(F.col("c_mktsegment"), tables.SEGMENT_OF, F.lit("New"))
    return customer.select(
        F.col("c_custkey").alias("user_id"), S.segment_code(segment).alias("segment_encoded")
    )


@query
def category_encode(s: Store) -> DataFrame:
    return s.table("part").select(
        F.col("p_partkey").alias("product_id"),
        S.encode(F.col("p_type"), CODES).alias("category_encoded"),
        S.encode(F.col("p_brand"), CODES).alias("unlisted_encoded"),
    )


@query
def user_vector(s: Store) -> DataFrame:
    features = U.user_features(s.users, s.ship, s.ship_as_of)
    rows = features.select("user_id", V.user_vector(features).alias("v"))
    return rows.select("user_id", *spread(rows, "v", "v", 17))


@query
def product_vector(s: Store) -> DataFrame:
    rows = s.products.select("product_id", V.product_vector().alias("v"))
    return rows.select("product_id", *spread(rows, "v", "v", 14))


@query
def pad_or_trim(s: Store) -> DataFrame:
    rows = s.products.select(
        "product_id",
        V.pad_or_trim(V.product_vector(), 17).alias("padded"),
        V.pad_or_trim(V.product_vector(), 5).alias("trimmed"),
    )
    return rows.select(
        "product_id",
        F.size("padded").alias("n_padded"),
        F.size("trimmed").alias("n_trimmed"),
        *spread(rows, "padded", "p", 17),
        *spread(rows, "trimmed", "t", 5),
    )


def web_pairs(s: Store) -> DataFrame:
    s.need("users", "products")
    pairs = keyed_join(s.web, s.staged_users, "user_id")
    return keyed_join(pairs, s.staged_products, "product_id")


@query
def price_ratio(s: Store) -> DataFrame:
    ratio = S.price_ratio(F.col("avg_order_value"), F.col("current_price"))
    return web_pairs(s).select("event_id", S.rnd(ratio, 4).alias("price_ratio"))


@query
def inventory_features(s: Store) -> DataFrame:
    return rounded(inventory.inventory_features(s.products, CODES))


@query
def pressure_label(s: Store) -> DataFrame:
    return rounded(inventory.inventory_pressure(s.products, CODES))


@query
def urgency_label(s: Store) -> DataFrame:
    scored = inventory.with_labels(inventory.inventory_pressure(s.products, CODES))
    return scored.select("product_id", "urgency_label")


@query
def sale_badge(s: Store) -> DataFrame:
    scored = inventory.with_labels(inventory.inventory_pressure(s.products, CODES))
    return scored.select("product_id", "should_show_sale_badge")


@query
def price_tier(s: Store) -> DataFrame:
    return s.products.select("product_id", S.price_tier(F.col("current_price")).alias("price_tier"))


@query
def treatment_arm(s: Store) -> DataFrame:
    return s.experiments.select(
        "product_id", "discount_pct", S.treatment_arm(F.col("discount_pct")).alias("treated")
    )


@query
def purchase_label(s: Store) -> DataFrame:
    return s.web.select("event_id", S.purchase_label(F.col("event_type")).alias("label"))


@query
def time_features(s: Store) -> DataFrame:
    parts = S.time_features(F.to_date("ts"))
    return s.web.select("event_id", *[value.alias(name) for name, value in parts.items()])


@query
def demand_velocity(s: Store) -> DataFrame:
    rows = D.rolling_demand(s.daily)
    value = S.velocity(F.col("demand_7d"), F.col("previous_7d"))
    return rows.filter(F.col("day_no") > 14).select(
        "product_id", "day_no", S.rnd(value, 6).alias("velocity")
    )


def pair_requests(s: Store) -> DataFrame:
    """One score request per web event, under the user's A/B variant; the event's value
    picks the product, which the catalogue may not hold."""
    experiment = F.lit(fixed.DEFAULT_EXPERIMENT)
    return s.web.select(
        F.col("event_id").alias("request_id"),
        "user_id",
        F.floor(F.col("price_paid") * 10).cast("bigint").alias("product_id"),
        X.variant(X.bucket(F.col("user_id"), experiment)).alias("weight_preset"),
    )


def scored_pairs(s: Store) -> DataFrame:
    catalogue = s.catalogue
    return R.score_pairs(pair_requests(s), s.segments, catalogue)


@query
def score_breakdown(s: Store) -> DataFrame:
    catalogue = s.catalogue
    rows = keyed_join(pair_requests(s), s.segments, "user_id")
    rows = keyed_join(rows, catalogue, "product_id", sketch=pair_requests(s))
    rows = R.rated(X.join_presets(rows, "weight_preset"))
    parts = R.score_breakdown(F.col("propensity_score")).alias("parts")
    return rows.select("request_id", "user_id", "product_id", parts).select(
        "request_id", "user_id", "product_id", "parts.*"
    )


@query
def storefront_flags(s: Store) -> DataFrame:
    flags = R.storefront_flags(ranked_for(s, s.request_all()))
    return flags.select(
        "user_id", "product_id", "show_trending", "show_markdown", "score_bar", "show_discount"
    )


@query
def elasticity_features(s: Store) -> DataFrame:
    return rounded(E.elasticity_features(s.products, CODES), 4)


@query
def propensity_features(s: Store) -> DataFrame:
    columns = V.propensity_columns(s.staged_users, CODES)
    return web_pairs(s).select(
        "event_id", *[S.rnd(column, 4).alias(name) for name, column in columns.items()]
    )


@query
def standard_scale(s: Store) -> DataFrame:
    rows = sampling.train_split(
        inventory.inventory_features(s.staged_products, CODES), F.col("product_id")
    )
    train = rows.filter("split = 'train'")
    return rounded(L.scaled_columns(rows, fixed.INVENTORY_COLUMNS, train), 4)


@query
def impute_defaults(s: Store) -> DataFrame:
    wanted = pair_requests(s).select("request_id", "product_id")
    shelf = U.product_features(s.staged_products, CODES).select(
        "product_id", *fixed.MISSING_PRODUCT
    )
    return rounded(U.impute_missing(keyed_join(wanted, shelf, "product_id", "left")), 4)


# Filters


@query
def purchases_only(s: Store) -> DataFrame:
    return rounded(U.purchases_only(s.web).select("event_id", "user_id", "product_id", "price_paid"))


@query
def negatives_only(s: Store) -> DataFrame:
    return U.negatives_only(s.web).select("event_id", "user_id", "product_id", "event_type")


@query
def recent_window(s: Store) -> DataFrame:
    rows = U.recent_purchases(s.ship, s.ship_as_of)
    return rounded(rows.select("user_id", "product_id", "ts", "price_paid", "quantity"), 4)


@query
def numeric_columns(s: Store) -> DataFrame:
    products = s.products.drop("product_id")
    values = drift.numeric_values(products).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"), S.rnd(F.min("value"), 4).alias("low"),
        S.rnd(F.max("value"), 4).alias("high"),
    )
    texts = drift.category_values(products).groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )
    return values.unionByName(texts)


def with_gaps(s: Store) -> DataFrame:
    """Users with web columns that are null where a user has no such events."""
    return (
        s.table("customer")
        .select(F.col("c_custkey").alias("user_id"), F.col("c_acctbal").alias("balance"))
        .join(U.average_prices(s.web), "user_id", "left")
        .join(U.last_viewed(s.web), "user_id", "left")
    )


@query
def drop_nulls(s: Store) -> DataFrame:
    columns = ["balance", "avg_price_paid", "last_viewed_product"]
    values = drift.numeric_values(with_gaps(s), columns)
    return rounded(
        values.groupBy("feature").agg(
            F.count(F.lit(1)).alias("n_values"), F.avg("value").alias("mean")
        )
    )


@query
def feature_lookup(s: Store) -> DataFrame:
    table = s.feature_table("products")
    found = feature_store.lookup(s.spark, table, "product_id", pair_requests(s).select("product_id"))
    return rounded(found.select("product_id", "category", "base_price", "margin_score"), 4)


@query
def validate_requests(s: Store) -> DataFrame:
    return U.validate_requests(s.requests)


# Joins


@query
def training_pairs(s: Store) -> DataFrame:
    s.need("users", "products")
    pairs = P.training_pairs(s.web, s.staged_users, s.staged_products, CODES)
    return rounded(
        pairs.select(
            "event_id", "user_id", "product_id", "label", "avg_order_value", "segment_encoded",
            "current_price", "category_encoded", "price_ratio",
        ),
        4,
    )


@query
def experiment_features(s: Store) -> DataFrame:
    return rounded(E.experiment_features(s.experiments, s.staged_products, CODES), 4)


@query
def user_features(s: Store) -> DataFrame:
    return rounded(U.user_features(s.users, s.ship, s.ship_as_of), 4)


@query
def demand_with_product(s: Store) -> DataFrame:
    rows = D.with_product(D.training_days(s.daily), s.staged_products, CODES)
    return rounded(rows.select("product_id", "day_no", "demand_7d", *D.PRODUCT_COLUMNS), 4)


def pool_of(s: Store) -> DataFrame:
    """Requests joined with their sampled products."""
    return R.candidate_pairs(
        s.request_all(), s.catalogue, "request_id", ["product_id", "product_index"], fixed.CANDIDATE_POOL[0]
    )


@query
def user_candidate_pairs(s: Store) -> DataFrame:
    return pool_of(s).select("user_id", "product_id")


@query
def discount_grid(s: Store) -> DataFrame:
    return rounded(E.discount_grid(s.products.select("product_id")))


@query
def similar_products(s: Store) -> DataFrame:
    return diversity.similar_products(s.products, 5)


@query
def similar_products_loose(s: Store) -> DataFrame:
    """Lists that reach beyond the own cluster."""
    return diversity.similar_products(s.products, 5, above=0.3)


@query
def unknown_users(s: Store) -> DataFrame:
    _, unknown = R.split_known(s.request_all(), s.web.select("user_id").distinct())
    return unknown.select("request_id", "user_id")


@query
def known_users(s: Store) -> DataFrame:
    known, _ = R.split_known(s.request_all(), s.web.select("user_id").distinct())
    return known.select("request_id", "user_id")


@query
def preset_join(s: Store) -> DataFrame:
    return X.join_presets(s.requests.select("request_id", "weight_preset"), "weight_preset")


@query
def product_score_join(s: Store) -> DataFrame:
    scored = R.product_scores(s.staged_products, s.pressure, s.spikes)
    return rounded(scored.select("product_id", "inventory_pressure", "demand_spike"))


# Aggregations


@query
def purchase_count_30d(s: Store) -> DataFrame:
    return U.purchase_counts(s.ship, s.ship_as_of)


@query
def avg_price_paid(s: Store) -> DataFrame:
    return rounded(U.average_prices(s.ship), 4)


@query
def last_viewed(s: Store) -> DataFrame:
    return U.last_viewed_category(s.web, s.products)


@query
def daily_demand(s: Store) -> DataFrame:
    return s.daily.withColumn("sale_day", F.date_format("sale_day", "yyyy-MM-dd"))


@query
def demand_baseline(s: Store) -> DataFrame:
    return rounded(D.demand_baseline(s.daily))


@query
def auc(s: Store) -> DataFrame:
    rows = s.table("lineitem").select(
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    return rounded(metrics.auc(rows, "score", "label"))


@query
def regression_metrics(s: Store) -> DataFrame:
    rows = D.training_days(s.daily)
    result = metrics.regression_metrics(rows, F.col("target_demand_7d"), F.col("demand_7d"))
    return rounded(result)


@query
def class_counts(s: Store) -> DataFrame:
    labelled = sampling.train_split(sampling.training_union(s.web), F.col("event_id"))
    return metrics.class_counts(labelled)


@query
def high_pressure_count(s: Store) -> DataFrame:
    return metrics.high_pressure_count(inventory.inventory_pressure(s.products, CODES))


@query
def badge_count(s: Store) -> DataFrame:
    return R.badge_counts(ranked_for(s, s.request_all()))


@query
def store_counts(s: Store) -> DataFrame:
    return U.store_counts(s.users, s.products)


@query
def variant_distribution(s: Store) -> DataFrame:
    return X.variant_distribution(X.ab_assign(s.request_all()))


def profiled(s: Store) -> DataFrame:
    """User columns that drift is fitted on."""
    return s.staged_users.drop("user_id")


def drift_columns(events: DataFrame, *more: Column) -> DataFrame:
    """Columns of an event source that both sources have, and more."""
    day = F.to_date("ts")
    return events.select(
        *more,
        "price_paid",
        F.col("quantity"),
        F.weekday(day).alias("weekday"),
        F.dayofmonth(day).alias("month_day"),
        "event_type",
        F.when(F.month(day) <= 6, "first").otherwise("second").alias("half_year"),
        F.date_format(day, "E").alias("day_name"),
    )


def reference_and_current(s: Store) -> tuple[drift.Profile, DataFrame]:
    """Shipped purchases as the reference, web events as what came later."""
    return drift.fit(drift_columns(s.shipments)), drift_columns(s.web)


@query
def category_proportions(s: Store) -> DataFrame:
    return rounded(drift.category_shares(drift.category_values(profiled(s))))


@query
def column_stats(s: Store) -> DataFrame:
    return rounded(drift.column_stats(drift.numeric_values(profiled(s))), 3)


@query
def quantile_edges(s: Store) -> DataFrame:
    edges = drift.quantile_edges(staging.stage(drift.numeric_values(profiled(s)), "values"))
    return rounded(edges.select("feature", F.posexplode("edges").alias("edge_no", "edge")), 4)


@query
def histogram(s: Store) -> DataFrame:
    values = staging.stage(drift.numeric_values(profiled(s)), "values")
    edges = staging.stage(drift.quantile_edges(values), "edges")
    return rounded(drift.histogram(values, edges), 4)


@query
def best_run(s: Store) -> DataFrame:
    logged = logged_runs(s)
    found = [
        runs.best_run(logged, metric, mode).select(
            F.lit(metric).alias("metric"), F.lit(mode).alias("mode"), "experiment", "run_name", "n_runs",
            "value",
        )
        for metric, mode in (("mean_discount", "max"), ("mean_quantity", "min"), ("absent", "max"))
    ]
    return rounded(found[0].unionByName(found[1]).unionByName(found[2]), 4)


# Windows


@query
def rolling_demand(s: Store) -> DataFrame:
    rows = D.rolling_demand(s.daily)
    return rows.select("product_id", "day_no", "demand_7d", "demand_14d", "demand_30d")


@query
def prev_week_demand(s: Store) -> DataFrame:
    return D.rolling_demand(s.daily).select("product_id", "day_no", "previous_7d")


@query
def next_7_target(s: Store) -> DataFrame:
    return D.rolling_demand(s.daily).select("product_id", "day_no", "target_demand_7d")


@query
def demand_training_set(s: Store) -> DataFrame:
    s.need("products", "daily")
    rows = D.training_set(s.daily, s.staged_products, CODES)
    return rounded(rows.withColumn("sale_day", F.date_format("sale_day", "yyyy-MM-dd")), 4)


@query
def latest_demand_features(s: Store) -> DataFrame:
    return rounded(s.latest, 4)


def plain_scores(s: Store) -> DataFrame:
    """Weighted score of every candidate, ready to rank."""
    catalogue = s.catalogue
    asked = X.join_presets(keyed_join(s.request_all(), s.segments, "user_id"), "weight_preset")
    pairs = R.rated(
        R.candidate_pairs(asked, catalogue, "request_id", R.SCORED, fixed.CANDIDATE_POOL[0])
    )
    return pairs.withColumns(
        {
            "score": R.weighted_score(F.col("propensity_score")),
            "cluster": F.col("style_cluster"),
            "tier": S.price_tier(F.col("current_price")),
        }
    )


def best_ten(s: Store) -> DataFrame:
    rows = plain_scores(s)
    return R.top_k(rows, R.group_of(rows, "user_id"), "score", 10)


@query
def rank_products(s: Store) -> DataFrame:
    rows = plain_scores(s)
    ranked = R.rank_by_score(rows, R.group_of(rows, "user_id"), "score")
    return ranked.select("user_id", "product_id", "score", "rank")


@query
def argmax_discount(s: Store) -> DataFrame:
    return E.best_of_grid(E.predict_uplift(s.staged_products, s.line_model))


# Top k, unions, samples


@query
def topk_per_user(s: Store) -> DataFrame:
    return best_ten(s).select("user_id", "product_id", "score", "rank")


@query
def cold_start(s: Store) -> DataFrame:
    store = s.web.select("user_id").distinct()
    _, unknown = R.split_known(s.request_all(), store)
    listed = R.cold_start(unknown, s.catalogue)
    return rounded(listed.drop("score_breakdown", "request_id"), 4)


@query
def training_union(s: Store) -> DataFrame:
    return sampling.training_union(s.web).select("event_id", "user_id", "product_id", "label")


@query
def negative_sample(s: Store) -> DataFrame:
    three = sampling.negative_sample(s.web).select(F.lit(3).alias("ratio"), "event_id")
    one = sampling.negative_sample(s.web, 1).select(F.lit(1).alias("ratio"), "event_id")
    return three.unionByName(one)


@query
def candidate_sample(s: Store) -> DataFrame:
    pool = R.candidate_pairs(
        s.request_all(candidate_pool=fixed.CANDIDATE_POOL[1]), s.catalogue, "request_id",
        ["product_index"], fixed.CANDIDATE_POOL[1],
    )
    return pool.select("user_id", "product_index")


@query
def train_val_split(s: Store) -> DataFrame:
    return sampling.train_split(s.web, F.col("event_id")).select("event_id", "split")


@query
def sample_users(s: Store) -> DataFrame:
    return sampling.sample_users(s.request_all().select("user_id"), 20)


# Models


@query
def propensity_train(s: Store) -> DataFrame:
    return s.fitted("propensity")[1]


@query
def propensity_score(s: Store) -> DataFrame:
    pairs = lookup_join(web_pairs(s), s.rate_model, "category", "left")
    return rounded(R.rated(pairs).select("event_id", "user_id", "product_id", "propensity_score"))


@query
def propensity_score_trees(s: Store) -> DataFrame:
    catalogue = s.catalogue
    model = s.fitted("propensity")[0]
    score = L.propensity_scorer(model, s.staged_users, CODES)
    ranked = R.recommend(s.request_all(), s.staged_users, catalogue, score)
    return ranked.select("user_id", "rank", "product_id", "propensity_score", "final_score")


@query
def elasticity_train(s: Store) -> DataFrame:
    return s.fitted("elasticity")[2]


@query
def elasticity_lines(s: Store) -> DataFrame:
    return rounded(s.lines, 4)


@query
def predict_uplift(s: Store) -> DataFrame:
    grid = E.predict_uplift(s.staged_products, s.line_model)
    return rounded(grid.select("product_id", "discount", "uplift"), 4)


@query
def optimal_discount(s: Store) -> DataFrame:
    return s.discounts


@query
def optimal_discount_trees(s: Store) -> DataFrame:
    control, treated, _ = s.fitted("elasticity")
    return E.best_of_grid(L.grid_uplift(s.staged_products, control, treated, CODES))


@query
def inventory_train(s: Store) -> DataFrame:
    return s.fitted("inventory")[1]


@query
def inventory_pressure(s: Store) -> DataFrame:
    return rounded(s.pressure)


@query
def inventory_pressure_trees(s: Store) -> DataFrame:
    model = s.fitted("inventory")[0]
    return inventory.with_labels(L.model_pressure(s.staged_products, model, CODES))


@query
def demand_train(s: Store) -> DataFrame:
    return s.fitted("demand")[1]


@query
def predict_demand(s: Store) -> DataFrame:
    return rounded(D.predict_closed_form(s.latest))


@query
def demand_spike_trees(s: Store) -> DataFrame:
    model = s.fitted("demand")[0]
    predicted = L.model_demand(s.latest, model) if model else D.predict_closed_form(s.latest)
    return D.demand_spikes(
        predicted, D.demand_baseline(s.daily), s.staged_products, fallback=model is None
    )


@query
def demand_spike(s: Store) -> DataFrame:
    return s.spikes


# Ranking, diversity, A/B


@query
def weighted_score(s: Store) -> DataFrame:
    return plain_scores(s).select("user_id", "product_id", "score")


def shown(ranked: DataFrame) -> DataFrame:
    """A ranked result with the breakdown flattened."""
    flat = ranked.select(
        "*", *[F.col(f"score_breakdown.{name}").alias(f"part_{name}") for name in fixed.SIGNALS]
    )
    return rounded(flat.drop("score_breakdown", "request_id"))


@query
def recommend(s: Store) -> DataFrame:
    return shown(ranked_for(s, s.request_all()))


@query
def recommend_plain(s: Store) -> DataFrame:
    asked = s.request_all(apply_diversity=False, weight_preset="clearance", top_k=10)
    return shown(ranked_for(s, asked))


@query
def recommend_whole(s: Store) -> DataFrame:
    """The whole catalogue as candidates, for users of every segment."""
    catalogue = s.catalogue
    return shown(R.recommend_whole(s.request_all(), s.segments, catalogue))


@query
def recommend_whole_scored(s: Store) -> DataFrame:
    """``recommend_whole`` for a scorer of which nothing is known but its largest value for a
    product."""
    catalogue = s.catalogue
    segments = [row["segment"] for row in s.segments.select("segment").distinct().collect()]
    highest = P.highest_rate(segments, F.col("segment_rates"))
    ranked = threshold.recommend_scored(s.request_all(), s.segments, catalogue, R.rated, highest=highest)
    return shown(ranked)


@query
def recommend_whole_trees(s: Store) -> DataFrame:
    """The whole catalogue under the trained propensity model."""
    catalogue = s.catalogue
    model = s.fitted("propensity")[0]
    ranked = forest.recommend_trees(s.request_all(), s.staged_users, catalogue, model, CODES)
    return ranked.select("user_id", "rank", "product_id", "propensity_score", "final_score")


@query
def recommend_whole_presets(s: Store) -> DataFrame:
    asked = X.under_every_preset(s.request_all(top_k=5).drop("weight_preset"))
    asked = asked.withColumn("request_id", F.concat_ws(":", "user_id", "weight_preset"))
    catalogue = s.catalogue
    ranked = R.recommend_whole(asked, s.segments, catalogue)
    return ranked.select("user_id", "weights_used", "rank", "product_id", "final_score")


@query
def recommend_stream(s: Store) -> DataFrame:
    """The requests of ``recommend`` arriving as a stream of files."""
    base = f"{staging.shared_folder(s.spark)}/stream-{staging.uuid.uuid4().hex}"
    asked, catalogue = s.request_all(), s.catalogue
    asked.write.parquet(f"{base}/requests")
    arriving = s.spark.readStream.schema(asked.schema).parquet(f"{base}/requests")
    answered = serving.serve(
        arriving, s.segments, catalogue, f"{base}/answers", f"{base}/progress"
    )
    answered.awaitTermination()
    return shown(s.spark.read.parquet(f"{base}/answers").drop("batch", "reject_reason"))


@query
def answer_requests(s: Store) -> DataFrame:
    """Requests with their own settings: ranked, cold start for users the store does not
    know, and the reason for those outside the limits."""
    catalogue = s.catalogue
    store = s.segments.join(s.web.select("user_id").distinct(), "user_id", "left_semi")
    answered = R.answer(s.requests, store, catalogue)
    return answered.groupBy("request_id", "user_id", "weights_used", "total_candidates", "reject_reason").agg(
        F.count("product_id").alias("n_products"),
        F.min_by("product_id", "rank").alias("first_product"),
    )


@query
def score_pair(s: Store) -> DataFrame:
    return scored_pairs(s)


@query
def product_similarity(s: Store) -> DataFrame:
    ranked = best_ten(s)
    traits = F.struct("cluster", "category", "tier")
    by_rank = Window.partitionBy(R.group_of(ranked, "user_id")).orderBy("rank")
    best = F.first(traits).over(by_rank)
    both = ranked.withColumns({"own": traits, "best": best})
    return both.select(
        "user_id", "product_id", diversity.similarity_columns("own", "best").alias("similarity")
    )


@query
def diversity_penalty(s: Store) -> DataFrame:
    ranked = best_ten(s)
    group = R.group_of(ranked, "user_id")
    rows = diversity.diversity_penalties(ranked, group, F.col("diversity"))
    return rows.select("user_id", "product_id", "rank", "diversity_penalty")


@query
def mmr_rerank(s: Store) -> DataFrame:
    scores = plain_scores(s)
    group = R.group_of(scores, "user_id")
    rows = scores.select(*group, "product_id", "score", "cluster", "category", "tier")
    return rounded(diversity.mmr_rerank(rows, group, F.lit(5), F.lit(0.25)).drop("slot"))


@query
def sale_badge_report(s: Store) -> DataFrame:
    return R.sale_badges(
        R.product_scores(
            E.with_discounts(inventory.with_pressure(s.staged_products, CODES), s.line_model),
            None,
            staging.stage(s.spikes, "spikes"),
        )
    )


@query
def nested_response(s: Store) -> DataFrame:
    """Nested and unpacked again: nothing is lost on the way."""
    nested = R.nested_response(ranked_for(s, s.request_all()))
    flat = nested.select("request_id", "user_id", "weights_used", "total_candidates", F.inline("products"))
    return shown(flat)


@query
def presets(s: Store) -> DataFrame:
    """Presets in use: the weights next to how many users are assigned to each."""
    assigned = X.variant_distribution(X.ab_assign(s.request_all()))
    table = X.preset_listing(s.spark)
    listed = F.broadcast(table.withColumnRenamed("name", "variant"))
    joined = assigned.join(listed, "variant", "right")
    return joined.select(
        F.col("variant").alias("name"),
        "description",
        F.coalesce("n_users", F.lit(0)).cast("bigint").alias("n_users"),
        F.explode("weights").alias("signal", "weight"),
    )


@query
def preset_validate(s: Store) -> DataFrame:
    used = s.requests.groupBy(X.known_preset(F.col("weight_preset")).alias("name")).agg(
        F.count(F.lit(1)).alias("n_requests")
    )
    checked = X.validate_presets(X.presets(s.spark))
    return used.join(F.broadcast(checked), "name").select(
        "name", "n_requests", "weight_sum", "is_valid"
    )


@query
def ab_assign(s: Store) -> DataFrame:
    return X.ab_assign(s.request_all())


@query
def preset_comparison(s: Store) -> DataFrame:
    asked = X.under_every_preset(s.request_all(top_k=5).drop("weight_preset"))
    asked = asked.withColumn("request_id", F.concat_ws(":", "user_id", "weight_preset"))
    ranked = ranked_for(s, asked)
    return ranked.select("user_id", "weights_used", "rank", "product_id", "final_score")


# Drift


@query
def drift_fit(s: Store) -> DataFrame:
    profile = drift.fit(profiled(s))
    numeric = profile.bins.join(
        F.broadcast(profile.numeric.drop("edges", "n_values")), "feature"
    ).select(
        "feature",
        F.lit("numeric").alias("kind"),
        F.col("bin_no").cast("string").alias("part"),
        S.rnd(F.col("low"), 4).alias("low"),
        S.rnd(F.col("share"), 6).alias("share"),
        S.rnd(F.col("mean"), 3).alias("mean"),
        S.rnd(F.col("std"), 3).alias("std"),
    )
    nothing = F.lit(None).cast("double")
    text = profile.shares.select(
        "feature",
        F.lit("categorical").alias("kind"),
        F.col("value").alias("part"),
        nothing.alias("low"),
        S.rnd(F.col("share"), 6).alias("share"),
        nothing.alias("mean"),
        nothing.alias("std"),
    )
    return numeric.unionByName(text)


@query
def psi(s: Store) -> DataFrame:
    return drift.psi(*reference_and_current(s)).select("feature", "psi", "out_of_range_count")


@query
def psi_level(s: Store) -> DataFrame:
    return drift.psi(*reference_and_current(s)).select("feature", "level")


@query
def chi_square(s: Store) -> DataFrame:
    return rounded(drift.chi_square(*reference_and_current(s)).drop("raw"), 3)


@query
def chi_square_p(s: Store) -> DataFrame:
    return drift.chi_square_levels(drift.chi_square(*reference_and_current(s)))


@query
def score_zscore(s: Store) -> DataFrame:
    asked = X.under_every_preset(s.request_all(top_k=5).drop("weight_preset"))
    asked = asked.withColumn("request_id", F.concat_ws(":", "user_id", "weight_preset"))
    ranked = staging.stage(ranked_for(s, asked), "ranked")
    reference = ranked.filter(F.col("weights_used") == fixed.DEFAULT_PRESET)
    mean = reference.agg(F.avg("final_score")).scalar()
    std = reference.agg(F.stddev_samp("final_score")).scalar()
    return rounded(drift.score_drift(ranked, "weights_used", "final_score", mean, std), 4)


def all_alerts(s: Store) -> DataFrame:
    """Alerts of the web events against shipments; what an event paid is its score, which is
    held against the reference's mean and deviation for each type of event."""
    profile, current = reference_and_current(s)
    paid = profile.numeric.where("feature = 'price_paid'").select("mean", "std").first()
    scores = drift.score_drift(s.web, "event_type", "price_paid", F.lit(paid["mean"]), F.lit(paid["std"]))
    return drift.check(profile, current, scores, "event_type")


@query
def drift_check(s: Store) -> DataFrame:
    return all_alerts(s).select("feature", "metric", "value", "threshold", "level")


@query
def drift_alert_text(s: Store) -> DataFrame:
    return drift.alert_text(all_alerts(s))


@query
def drift_summary(s: Store) -> DataFrame:
    return drift.summary(drift.fit(profiled(s)))


@query
def drift_profile_merged(s: Store) -> DataFrame:
    """The profile of all shipments from summaries of each year's."""
    rows = drift_columns(s.shipments, F.year("ts").alias("year"))
    yearly = staging.stage(profiles.summarise(rows, by=["year"]), "yearly")
    profile = profiles.profile_of(profiles.merge(yearly))
    bins = profile.bins.join(F.broadcast(profile.numeric.drop("edges", "n_values")), "feature").select(
        "feature", F.col("bin_no").cast("string").alias("part"), "n", S.rnd(F.col("low"), 4).alias("low"),
        S.rnd(F.col("mean"), 3).alias("mean"), S.rnd(F.col("std"), 3).alias("std"),
    )
    none = F.lit(None).cast("double")
    return bins.unionByName(
        profile.shares.select(
            "feature", F.col("value").alias("part"), "n", none.alias("low"), none.alias("mean"), none.alias("std")
        )
    )


@query
def drift_windows(s: Store) -> DataFrame:
    """Index and level of every week of web events, which arrive as a stream of files, over
    the limits; the weeks that the watermark has not passed are still open."""
    base = f"{staging.session_folder(s.spark)}/windows-{staging.uuid.uuid4().hex}"
    profile = drift.fit(drift_columns(s.shipments))
    rows = staging.stage(drift_columns(s.web, F.col("ts").cast("timestamp").alias("ts")), "web_rows")
    early = rows.agg(F.timestamp_micros(F.avg(F.unix_micros("ts")).cast("bigint"))).scalar()
    for arrived in (F.col("ts") < early, F.col("ts") >= early):
        rows.where(arrived).write.mode("append").parquet(f"{base}/events")
    stream = s.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/events")
    serving.watch_windows(
        stream, profile, "ts", f"{base}/alerts", f"{base}/progress", length="7 days", late="7 days"
    ).awaitTermination()
    alerts = s.spark.read.parquet(f"{base}/alerts").where("metric = 'PSI'")
    start = F.date_format("window_start", "yyyy-MM-dd").alias("window_start")
    return alerts.select(start, "feature", "value", "level")


# Run log


@query
def log_run(s: Store) -> DataFrame:
    return flat_maps(logged_runs(s))


@query
def log_weights(s: Store) -> DataFrame:
    listing = F.broadcast(X.preset_listing(s.spark).select("name", "weights"))
    experiment = F.lit(fixed.DEFAULT_EXPERIMENT)
    chosen = logged_runs(s).withColumn(
        "name", X.variant(X.bucket(F.col("run_name"), experiment))
    )
    logged = runs.log_weights(chosen.join(listing, "name"), F.col("name"), F.col("weights"))
    return logged.select("experiment", "run_name", F.explode("params").alias("key", "value"))


@query
def run_summary(s: Store) -> DataFrame:
    table = runs.run_summary(logged_runs(s))
    return table.select(
        "experiment",
        "run_name",
        "seconds",
        F.size("params").alias("n_params"),
        F.size("metrics").alias("n_metrics"),
        S.rnd(F.col("metrics")["mean_discount"], 4).alias("mean_discount"),
    )
