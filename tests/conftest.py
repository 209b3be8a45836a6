import pytest

from vitrine.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=8, partitions=8)
    yield session
    session.stop()


@pytest.fixture(scope="session")
def shop(spark):
    from tests import small
    from vitrine.sources.staging import stage
    from vitrine.sources.tables import derived_columns

    products = spark.createDataFrame(small.product_rows(), small.PRODUCT_SCHEMA)
    tables = {
        "users": spark.createDataFrame(small.user_rows(), small.USER_SCHEMA),
        "products": derived_columns(products),
        "events": spark.createDataFrame(small.event_rows(), small.EVENT_SCHEMA),
        "experiments": spark.createDataFrame(
            small.experiment_rows(),
            "product_id string, discount_pct double, conversion_rate double",
        ),
    }
    return {name: stage(table, name) for name, table in tables.items()}


@pytest.fixture(scope="session")
def shelf(shop):
    """The staged catalogue of the small shop, with every closed-form score."""
    from vitrine import fixed
    from vitrine.operators import demand, elasticity, inventory, propensity, ranking

    products, codes = shop["products"], fixed.CATEGORY_CODES
    daily = demand.daily_demand(shop["events"])
    latest = demand.latest_features(daily, products, codes)
    spikes = demand.demand_spikes(
        demand.predict_closed_form(latest), demand.demand_baseline(daily), products
    )
    lines = elasticity.fit_lines(shop["experiments"], products)
    scored = ranking.product_scores(
        products,
        inventory.inventory_pressure(products, codes),
        spikes,
        elasticity.optimal_discounts(products, lines),
        propensity.fit_rates(shop["events"], shop["users"], products),
    )
    return ranking.catalogue(scored, ranking.positions(products))
