"""Feature tables that are built once and looked up by key.

A published table is bucketed and sorted by its key, one file a bucket, so a lookup of a few
keys reads the buckets that can hold them and, inside, the row groups whose ranges do.  A
lookup of many keys is a join that shuffles only the keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64
# Keys that are looked up by name; more are joined.
MOST_KEYS = 1000


def publish(table: DataFrame, key: str, path: str, name: str, buckets: int = BUCKETS) -> None:
    """Write a feature table to ``path`` and enter it in the session's catalogue."""
    table.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key).option(
        "path", path
    ).saveAsTable(name)


def attach(spark: SparkSession, schema: str, key: str, path: str, name: str, buckets: int = BUCKETS) -> None:
    """Enter a table that another session published; ``schema`` and bucketing as written."""
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key})"
        f" INTO {buckets} BUCKETS LOCATION '{path}'"
    )


def lookup(spark: SparkSession, name: str, key: str, wanted: DataFrame) -> DataFrame:
    """One row for each distinct wanted key that is not null, with nulls where it is absent."""
    keys = wanted.select(key).where(F.col(key).isNotNull()).distinct()
    table = spark.table(name)
    few = [row[0] for row in keys.limit(MOST_KEYS + 1).collect()]
    if len(few) > MOST_KEYS:
        return keys.join(table, key, "left")
    named = spark.createDataFrame([(k,) for k in few], keys.schema)
    # At most MOST_KEYS rows are left of the table.
    return named.join(F.broadcast(table.where(F.col(key).isin(few))), key, "left")
