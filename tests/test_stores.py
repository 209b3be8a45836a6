"""Published models and feature tables."""

import threading

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from vitrine.sources import feature_store, model_store


def model(spark, factor):
    step = SQLTransformer(statement=f"SELECT *, x * {factor} AS y FROM __THIS__")
    return Pipeline(stages=[step]).fit(spark.range(1).withColumn("x", F.lit(1.0)))


def value(spark, models):
    return models["m"].transform(spark.range(1).withColumn("x", F.lit(1.0))).first().y


def test_versions(spark, tmp_path):
    store = model_store.Store(spark, str(tmp_path / "models"))
    with pytest.raises(FileNotFoundError):
        store.read()
    first = store.publish({"m": model(spark, 2)}, t=spark.range(2))
    second = store.publish({"m": model(spark, 3)}, t=spark.range(3))
    assert store.versions() == [first, second] and store.latest() == second
    models, tables = store.read()
    assert value(spark, models) == 3 and tables["t"].count() == 3
    models, tables = store.read(first)
    assert value(spark, models) == 2 and tables["t"].count() == 2
    third = store.publish({"m": model(spark, 4)}, t=spark.range(4))
    store.forget(keep=2)
    assert store.versions() == [second, third]
    assert len(list((tmp_path / "models" / "versions").iterdir())) == 2


def test_a_save_that_fails_is_not_seen(spark, tmp_path):
    store = model_store.Store(spark, str(tmp_path / "models"))
    store.publish({"m": model(spark, 2)}, t=spark.range(2))
    broken = spark.range(3).select(F.raise_error(F.lit("disk full")).alias("id"))
    with pytest.raises(Exception):
        store.publish({"m": model(spark, 3)}, t=broken)
    models, tables = store.read()
    assert value(spark, models) == 2 and tables["t"].count() == 2


def test_a_manifest_being_written_is_not_followed(spark, tmp_path):
    store = model_store.Store(spark, str(tmp_path / "models"))
    first = store.publish({"m": model(spark, 2)})
    (tmp_path / "models" / "manifests" / "00000002-x.json").write_text('{"folder": "vers')
    assert store.latest() == first and value(spark, store.read()[0]) == 2
    store.publish({"m": model(spark, 5)})
    assert value(spark, store.read()[0]) == 5


def test_readers_see_whole_versions_during_saves(spark, tmp_path):
    """The table of version n has n rows and its model multiplies by n."""
    store = model_store.Store(spark, str(tmp_path / "models"))
    store.publish({"m": model(spark, 1)}, t=spark.range(1))
    writer = threading.Thread(
        target=lambda: [store.publish({"m": model(spark, n)}, t=spark.range(n)) for n in range(2, 6)]
    )
    writer.start()
    seen = set()
    while writer.is_alive() or not seen:
        models, tables = store.read()
        n = tables["t"].count()
        assert value(spark, models) == n
        seen.add(n)
    writer.join()
    assert value(spark, store.read()[0]) == 5


def test_saves_at_the_same_time_are_both_kept(spark, tmp_path):
    stores = [model_store.Store(spark, str(tmp_path / "models")) for _ in range(2)]
    fitted = model(spark, 2)
    made = []
    threads = [threading.Thread(target=lambda s=s: made.append(s.publish({"m": fitted}))) for s in stores]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert stores[0].versions() == sorted(made) and len(set(made)) == 2
    assert all(isinstance(stores[0].read(v)[0]["m"], PipelineModel) for v in made)


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features") / "t")
    table = spark.range(5000).select("id", (F.col("id") * 2).alias("double"))
    feature_store.publish(table, "id", path, "lookup_test", buckets=16)
    yield path
    spark.sql("DROP TABLE lookup_test")


def test_lookup_reads_only_the_buckets_needed(spark, tmp_path):
    """With all other files spoilt the rows are still found."""
    table = spark.range(500).select("id", (F.col("id") * 2).alias("double"))
    feature_store.publish(table, "id", str(tmp_path / "t"), "lookup_spoilt", buckets=16)
    wanted = spark.createDataFrame([(3,), (3,), (9999,), (None,)], "id long")
    needed = {r[0] for r in wanted.where("id is not null").select(F.pmod(F.hash("id"), F.lit(16))).collect()}
    for file in (tmp_path / "t").glob("part-*.parquet"):
        if int(file.name.split("_")[-1].split(".")[0]) not in needed:
            file.write_text("spoilt")
            (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
    found = feature_store.lookup(spark, "lookup_spoilt", "id", wanted)
    assert sorted((r.id, r["double"]) for r in found.collect()) == [(3, 6), (9999, None)]
    spark.sql("DROP TABLE lookup_spoilt")


def test_lookup_of_many_keys_shuffles_only_them(spark, published, monkeypatch):
    monkeypatch.setattr(feature_store, "MOST_KEYS", 10)
    wanted = spark.range(4990, 5010)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = feature_store.lookup(spark, "lookup_test", "id", wanted)
        assert {r.id: r["double"] for r in found.collect()} == {i: 2 * i if i < 5000 else None for i in range(4990, 5010)}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert "Bucketed: true" in plan
        assert plan.count("Exchange hashpartitioning") == 1  # of the keys, for distinct and join
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_a_table_of_another_session(spark, published):
    feature_store.attach(spark, "id BIGINT, double BIGINT", "id", published, "lookup_again", 16)
    found = feature_store.lookup(spark, "lookup_again", "id", spark.range(2))
    assert sorted((r.id, r["double"]) for r in found.collect()) == [(0, 0), (1, 2)]
    spark.sql("DROP TABLE lookup_again")


def test_empty_lookup(spark, published):
    assert feature_store.lookup(spark, "lookup_test", "id", spark.range(0)).count() == 0
