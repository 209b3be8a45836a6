"""Drift checks and the run log."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from vitrine.operators import drift, profiles, runs
from vitrine.operators.experiments import preset_listing
from vitrine.sources import runlog


def numbers(spark, values, name="x"):
    return spark.createDataFrame([(v,) for v in values], f"{name} double")


def test_psi_by_hand(spark):
    profile = drift.fit(numbers(spark, [float(v) for v in range(100)]), bins=2)
    current = numbers(spark, [10.0] * 30 + [80.0] * 10 + [500.0] * 7 + [None])
    row = drift.psi(profile, current).first()
    p, q = [0.5, 0.5], [0.75, 0.25]
    assert row.psi == pytest.approx(sum((b - a) * math.log(b / a) for a, b in zip(p, q)), abs=1e-6)
    assert row.out_of_range_count == 7 and row.level == "critical"


def test_same_data_has_no_drift(spark):
    r = random.Random(1)
    table = spark.createDataFrame([(r.gauss(0, 1), r.choice("abc"), r.randint(0, 3)) for _ in range(500)], "x double, c string, k int")
    profile = drift.fit(table)
    assert drift.check(profile, table).count() == 0
    assert {r.psi for r in drift.psi(profile, table).collect()} == {0.0}


def test_constant_column(spark):
    profile = drift.fit(numbers(spark, [5.0, 5.0, 5.0]))
    row = drift.psi(profile, numbers(spark, [5.0, 6.0])).first()
    assert (row.psi, row.level, row.out_of_range_count) == (0.0, "none", 1)


def test_approximate_edges(spark):
    table = numbers(spark, [float(v) for v in range(2000)] + [7.0] * 500)
    exact, rough = drift.fit(table), drift.fit(table, exact=False)
    pairs = zip(exact.numeric.first().edges, rough.numeric.first().edges)
    assert all(abs(a - b) <= 2 for a, b in pairs)
    moved = numbers(spark, [v * 0.5 for v in range(2000)])
    assert drift.psi(rough, moved).first().level == drift.psi(exact, moved).first().level == "critical"


def test_missing_columns_are_skipped(spark):
    profile = drift.fit(spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 3.0, "b")], "x double, y double, c string"))
    got = drift.psi(profile, numbers(spark, [1.0, 2.0]))
    assert [r.feature for r in got.collect()] == ["x"]
    assert drift.check(profile, spark.createDataFrame([("z",)], "other string")).count() == 0


def test_text_only_and_number_only_profiles(spark):
    text = drift.fit(spark.createDataFrame([("a",), ("b",)], "c string"))
    assert text.numeric_names == [] and drift.summary(text).count() == 1
    number = drift.fit(numbers(spark, [1.0, 2.0, 3.0]))
    assert number.category_names == [] and drift.summary(number).count() == 1


def test_chi_square_by_hand(spark):
    reference = spark.createDataFrame([("a",)] * 40 + [("b",)] * 40 + [("c",)] * 20, "c string")
    current = spark.createDataFrame([("a",)] * 30 + [("b",)] * 50 + [("c",)] * 20 + [("new",)] * 9 + [(None,)], "c string")
    row = drift.chi_square_levels(drift.chi_square(drift.fit(reference), current)).first()
    assert (row.statistic, row.dof, row.unseen_count) == (5.0, 2, 9)
    assert row.p_value == pytest.approx(0.082085, abs=1e-6) and row.level == "none"


@pytest.mark.parametrize(
    "statistic, dof, p",
    # Values of the chi-square distribution from printed tables.
    [(3.841, 1, 0.05), (6.635, 1, 0.01), (5.991, 2, 0.05), (7.815, 3, 0.05), (18.307, 10, 0.05), (124.342, 100, 0.05), (0.0, 4, 1.0), (5.0, 0, 1.0)],
)
def test_p_values(spark, statistic, dof, p):
    assert drift.p_value(spark, statistic, dof) == pytest.approx(p, abs=2e-5)


def test_p_values_far_out(spark):
    assert drift.p_value(spark, 5000.0, 3) == 0.0
    assert drift.p_value(spark, 100_000.0, 100_001) == pytest.approx(0.5, abs=0.01)


def parts_of(profile):
    return (
        sorted((r.feature, r.bin_no, r.low, r.high, r.n) for r in profile.bins.collect()),
        sorted((r.feature, r.value, r.n, r.share) for r in profile.shares.collect()),
        {r.feature: (r.edges, r.n_values) for r in profile.numeric.collect()},
    )


def test_merged_profiles(spark):
    """Summaries of parts, merged in any order, make the profile of the whole."""
    r = random.Random(4)
    rows = [
        (i % 5, r.choice([r.gauss(0, 50), 0.0, -3.0, r.random() * 1e-4, float("nan"), None]), r.randint(-2, 9), r.choice(["a", "b", None]))
        for i in range(3000)
    ] + [(9, math.inf, 1, "c"), (9, -math.inf, 1, "c")]
    table = spark.createDataFrame(rows, "part int, x double, k int, c string").repartition(6)
    whole = profiles.profile_of(profiles.summarise(table.drop("part")))
    days = [profiles.summarise(table.where(F.col("part") == p).drop("part")) for p in (9, 3, 0, 1, 2, 4)]
    merged = days[0]
    for day in days[1:]:
        merged = profiles.merge(merged, day)
    by_part = profiles.merge(profiles.summarise(table, by=["part"]))
    assert parts_of(profiles.profile_of(merged)) == parts_of(whole) == parts_of(profiles.profile_of(by_part))


def test_summary_profile_is_close_to_exact(spark):
    r = random.Random(6)
    table = spark.createDataFrame(
        [(r.lognormvariate(3, 1), r.choice("abc")) for _ in range(4000)], "x double, c string"
    )
    rough, exact = profiles.profile_of(profiles.summarise(table)), drift.fit(table)
    one, other = rough.numeric.first(), exact.numeric.first()
    assert one["mean"] == pytest.approx(other["mean"], abs=1e-6) and one["std"] == pytest.approx(other["std"], rel=1e-9)
    assert all(abs(a - b) <= 0.01 * abs(b) for a, b in zip(one.edges, other.edges))
    values = sorted(v.x for v in table.collect())
    bins = sorted(rough.bins.collect(), key=lambda b: b.bin_no)
    for b in bins[:-1]:
        assert b.n == sum(b.low <= v < b.high for v in values)
    assert sum(b.n for b in bins) == 4000 and drift.check(rough, table).count() == 0


@pytest.mark.parametrize("partitions", [1, 7])
def test_bins_from_ranks_equal_the_histogram(spark, partitions):
    r = random.Random(partitions)
    rows = [(r.gauss(0, 1), float(r.randint(0, 4)), 7.0) for _ in range(5000)]
    table = spark.createDataFrame(rows, "x double, k double, one double").repartition(partitions)
    profile = drift.fit(table)
    values = drift.numeric_values(table)
    expected = drift.histogram(values, drift.quantile_edges(values))
    pick = lambda t: sorted((b.feature, b.bin_no, b.low, b.high, b.n, b.share) for b in t.collect())
    assert pick(profile.bins) == pick(expected)


def test_values_outside_brackets_are_not_shuffled(spark):
    """Of 200,000 distinct values only those near an edge are counted as themselves."""
    from vitrine.operators import quantiles

    values = spark.range(200_000).select(F.lit("x").alias("feature"), (F.col("id") * 37 % 200_003).cast("double").alias("value"))
    sketches = quantiles.sketched(values, 10).cache()
    counted = quantiles.counted_in_brackets(values, sketches, 10)
    assert counted.where("value is not null").count() < 0.04 * 200_000
    assert counted.agg(F.sum("n")).first()[0] == 200_000


def test_alert_levels_and_text(spark):
    r = random.Random(2)
    old = spark.createDataFrame([(r.random(), r.choice("ab")) for _ in range(1000)], "x double, c string")
    new = spark.createDataFrame([(r.random() ** 3, "a") for _ in range(1000)], "x double, c string")
    alerts = {a.feature: a for a in drift.alert_text(drift.check(drift.fit(old), new)).collect()}
    assert alerts["x"].metric == "PSI" and alerts["x"].level == "critical" and alerts["x"].threshold == 0.1
    assert alerts["c"].metric == "chi2_pvalue" and alerts["c"].threshold == 0.01
    assert alerts["x"].message == f"Distribution shift detected in 'x' (PSI={alerts['x'].value:.4f})"
    assert alerts["x"].text.startswith("🚨 [CRITICAL] x: PSI=")


def test_score_drift(spark):
    rows = [("low", 0.5), ("low", 0.5), ("warn", 0.75), ("far", 0.9)]
    table = spark.createDataFrame(rows, "g string, score double")
    rated = drift.score_drift(table, "g", "score", F.lit(0.5), F.lit(0.1))
    assert {r.g: r.level for r in rated.collect()} == {"low": "none", "warn": "warning", "far": "critical"}
    alerts = {a.feature: a for a in drift.score_alerts(rated, "g").collect()}
    assert alerts["warn"].message == "Score distribution warning: mean shifted 2.5σ from baseline"
    assert alerts["far"].value == 4.0 and alerts["far"].threshold == 3.0


RUN = "experiment string, run_name string, start_time timestamp_ntz, end_time timestamp_ntz"


@pytest.fixture()
def logged(spark):
    base = spark.sql(
        """select 'e' as experiment, name as run_name, timestamp_ntz'2024-01-01 00:00:00' as start_time,
                  timestamp_ntz'2024-01-01 00:00:02.5' as end_time from values ('a'), ('b'), ('c') as t(name)"""
    )
    entries = spark.createDataFrame(
        [
            ("e", "a", "params", "depth", "6", 1), ("e", "a", "params", "depth", "5", 2),
            ("e", "a", "metrics", "auc", "0.7", 1), ("e", "b", "metrics", "auc", "0.9", 1),
            ("e", "b", "tags", "note", "second", 1),
        ],
        "experiment string, run_name string, kind string, key string, value string, seq int",
    )
    return runs.log_runs(base, entries)


def test_last_entry_wins(logged):
    rows = {r.run_name: r for r in logged.collect()}
    assert rows["a"].params == {"depth": "5"} and rows["a"].metrics == {"auc": 0.7}
    assert rows["b"].tags == {"note": "second"} and rows["b"].params == {}
    assert rows["c"].params == {} and rows["c"].metrics == {}


def test_summary_and_best_run(logged):
    assert {r.seconds for r in runs.run_summary(logged).collect()} == {2.5}
    assert runs.best_run(logged, "auc").first().run_name == "b"
    assert runs.best_run(logged, "auc", "min").first().run_name == "a"
    assert runs.best_run(logged, "absent").count() == 0
    with pytest.raises(ValueError):
        runs.best_run(logged, "auc", "median")


def test_log_weights(spark, logged):
    weights = preset_listing(spark).filter("name = 'dyson'").select("name", "weights")
    row = runs.log_weights(logged.crossJoin(weights), F.col("name"), F.col("weights")).filter("run_name = 'a'").first()
    assert row.params["weight_preset"] == "dyson" and row.params["w_trend"] == "0.25"
    assert row.params["depth"] == "5" and row.params["w_diversity_lambda"] == "0.1"


def test_write_read_and_corrupt_files(spark, logged, tmp_path):
    path = str(tmp_path / "runs")
    times = {n: F.col(n).cast("string") for n in ("start_time", "end_time")}
    runlog.write_runs(logged.withColumns(times), path)
    runlog.write_runs(logged.withColumns(times), path)
    back = runlog.read_runs(spark, path)
    assert back.count() == 6 and back.filter("metrics['auc'] = 0.9").count() == 2

    folder = tmp_path / "foreign" / "experiment=other"
    folder.mkdir(parents=True)
    whole = {"run_name": "r", "start_time": "2024-01-01T00:00:00", "params": {"a": "b"}, "metrics": {"auc": 0.5}, "tags": {}}
    (folder / "good.json").write_text(json.dumps(whole, indent=2))
    (folder / "cut.json").write_text(json.dumps(whole, indent=2)[:60])
    rows = runlog.read_runs(spark, str(tmp_path / "foreign"), multi_line=True).collect()
    assert len(rows) == 2
    good, bad = sorted(rows, key=lambda r: r.corrupt_record is not None)
    assert good.metrics == {"auc": 0.5} and good.corrupt_record is None
    assert bad.run_name is None and bad.corrupt_record and bad.source_file.endswith("cut.json")


def test_windows_of_a_stream_equal_batch_checks(spark, tmp_path):
    """Alerts of a day whose rows came in several batches are those of the day's rows."""
    import datetime

    from vitrine.streaming import serving

    r = random.Random(8)
    start = datetime.datetime(2024, 1, 1)

    def event(day, second):
        shift = 2.0 if day == 1 else 0.0
        group = r.choice("ab") if day != 2 else r.choice("aaaaab")
        return (start + datetime.timedelta(days=day, seconds=second), r.gauss(shift, 1), group)

    schema = "ts timestamp, x double, c string"
    reference = spark.createDataFrame([event(0, 0)[1:] for _ in range(2000)], "x double, c string")
    profile = drift.fit(reference)
    rows = sorted((event(day, s) for day in range(4) for s in range(0, 86_400, 120)), key=lambda e: e[0])
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    alerts = {}
    for batch in range(9):  # batches do not end where days do
        part = rows[batch * len(rows) // 9 : (batch + 1) * len(rows) // 9]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        serving.watch_windows(stream, profile, "ts", out, str(tmp_path / "progress"), late="1 hour").awaitTermination()
    for a in spark.read.parquet(out).collect():
        alerts.setdefault(a.window_start.day - 1, set()).add((a.feature, a.metric, a.value, a.level))
    for day in range(3):
        own = spark.createDataFrame([e for e in rows if e[0].day - 1 == day], schema).drop("ts")
        batch = {(a.feature, a.metric, a.value, a.level) for a in drift.check(profile, own).collect()}
        assert alerts.get(day, set()) == batch
    assert alerts[1] and alerts[2] and 3 not in alerts
