"""Run log: entries merged into runs, weights, summary, best run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RUN_KEY = ["experiment", "run_name"]
MAP_TYPES = {
    "params": "map<string,string>",
    "metrics": "map<string,double>",
    "tags": "map<string,string>",
}


def log_runs(runs: DataFrame, entries: DataFrame) -> DataFrame:
    """Merge entries (run key, kind, key, value, seq) into the runs' maps.

    Of several entries for one key the last wins, decided before anything is collected,
    so a run's map holds one value per name.
    """
    last = entries.groupBy(*RUN_KEY, "kind", "key").agg(F.max_by("value", "seq").alias("value"))

    def merged(kind: str) -> Column:
        pairs = F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "value")))
        typed = F.map_from_entries(pairs).cast(MAP_TYPES[kind])
        return typed.alias(kind)

    maps = last.groupBy(*RUN_KEY).agg(*[merged(kind) for kind in MAP_TYPES])
    joined = runs.join(maps, RUN_KEY, "left")
    return joined.withColumns(
        {
            kind: F.coalesce(F.col(kind), F.create_map().cast(type_name))
            for kind, type_name in MAP_TYPES.items()
        }
    )


def log_weights(runs: DataFrame, preset: Column, weights: Column) -> DataFrame:
    """Add a preset's name and its weights, prefixed with ``w_``, to the params."""
    named = F.transform_keys(weights, lambda key, _: F.concat(F.lit("w_"), key))
    named = F.map_concat(
        F.create_map(F.lit("weight_preset"), preset), named.cast(MAP_TYPES["params"])
    )
    kept = F.map_filter("params", lambda key, _: ~F.map_contains_key(named, key))
    return runs.withColumn("params", F.map_concat(kept, named))


def run_summary(runs: DataFrame) -> DataFrame:
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp"))
               - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1e6
    return runs.select(
        *RUN_KEY, "start_time", "end_time", seconds.alias("seconds"), "params", "metrics", "tags"
    )


def best_run(runs: DataFrame, metric: str, mode: str = "max") -> DataFrame:
    """Run with the highest or lowest value of a metric per experiment; no row without one."""
    if mode not in ("max", "min"):
        raise ValueError(f"mode must be max or min, not {mode}")
    value = F.col("metrics")[metric]
    eligible = runs.filter(F.map_contains_key("metrics", metric) & value.isNotNull())
    # Among equals the run that comes first by name.
    if mode == "max":
        pick = F.min_by("run_name", F.struct(-value, F.col("run_name")))
        best = F.max(value)
    else:
        pick = F.min_by("run_name", F.struct(value, F.col("run_name")))
        best = F.min(value)
    return eligible.groupBy("experiment").agg(
        pick.alias("run_name"), best.alias("value"), F.count(F.lit(1)).alias("n_runs")
    )
