"""Joins of event rows with keyed tables, safe against hot keys."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.sources.staging import is_small, planned_bytes

SKETCH_ITEMS = 8192
# A sketch this size tells keys apart down to about this share of the rows.
MOST_PARTS = 2048
UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}


def size_in_bytes(text: str) -> int:
    """A size setting such as ``10485760``, ``10MB`` or ``10m``; -1 stays -1."""
    found = re.fullmatch(r"\s*(-?\d+)\s*([bkmgtp]?)(?:i?b)?\s*", text.lower())
    if not found:
        raise ValueError(f"not a size: {text!r}")
    return int(found[1]) * UNITS[found[2]]


def broadcast_limit(table: DataFrame) -> int:
    text = table.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")
    return size_in_bytes(text)


def parts(table: DataFrame) -> int:
    """Shuffle partitions, within what the sketch can tell apart."""
    return max(8, min(MOST_PARTS, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))))


def hot_keys(rows: DataFrame, key: str) -> DataFrame:
    """(hot_key, salts): keys with more rows than a shuffle partition has on average.

    One pass with a fixed-size sketch.  ``salts`` is how many average partitions a key would
    fill, so after salting no key holds more than about one.
    """
    n_parts = parts(rows)
    most = F.col("n") / n_parts
    return (
        rows.agg(
            F.expr(f"approx_top_k({key}, {n_parts}, {max(SKETCH_ITEMS, 4 * n_parts)})").alias("top"),
            F.count(F.lit(1)).alias("n"),
        )
        .select(F.explode("top").alias("entry"), "n")
        .filter((F.col("entry.count") > most) & F.col("entry.item").isNotNull())
        .select(
            F.col("entry.item").alias("hot_key"),
            F.least(F.ceil(F.col("entry.count") / most) * 2, F.lit(n_parts)).cast("bigint").alias("salts"),
        )
    )


def salted_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    unique: str | None = None,
    sketch: DataFrame | None = None,
) -> DataFrame:
    """Join on (key, salt): rows of a hot key are spread over as many salts as it needs.

    The salt is a hash of the ``unique`` column, or else of the whole row, so a retried task
    sends each row to the same place; rows that may be equal need a unique column to be
    spread.  Rows without a key match nothing and are spread too.  There are fewer hot keys
    than shuffle partitions, which bounds what is sent to all executors.
    """
    hot = F.broadcast(hot_keys(rows if sketch is None else sketch, key))
    columns = [F.col(f"r.`{name}`") for name in ([unique] if unique else rows.columns)]
    hashed = F.xxhash64(F.lit("salt"), *columns)
    first = F.lit(0).cast("bigint")
    spread = (
        F.when(F.col("hot_key").isNotNull(), F.pmod(hashed, F.col("salts")))
        .when(F.col(f"r.`{key}`").isNull(), F.pmod(hashed, F.lit(parts(rows))))
        .otherwise(first)
    )
    salted_rows = rows.alias("r").join(hot, F.col(f"r.`{key}`") == F.col("hot_key"), "left").select(
        "r.*", spread.alias("salt")
    )
    copies = F.when(
        F.col("hot_key").isNotNull(), F.sequence(first, F.col("salts") - 1)
    ).otherwise(F.array(first))
    salted_table = table.alias("t").join(hot, F.col(f"t.`{key}`") == F.col("hot_key"), "left").select(
        "t.*", F.explode(copies).alias("salt")
    )
    return salted_rows.join(salted_table, [key, "salt"], how).drop("salt")


def keyed_join(
    rows: DataFrame,
    table: DataFrame,
    key: str,
    how: str = "inner",
    sketch: DataFrame | None = None,
    unique: str | None = None,
) -> DataFrame:
    """Join many rows with a table that holds each key once.

    A table the planner knows to be under its broadcast threshold is left to the planner,
    which then shuffles nothing.  Any other join is salted.  Hot keys are looked for in
    ``sketch``, a cheaper table with the same key column, or in the rows themselves.
    ``how`` is inner, left, left_semi or left_anti.
    """
    if planned_bytes(table) <= broadcast_limit(table):
        return rows.join(table, key, how)
    return salted_join(rows, table, key, how, unique=unique, sketch=sketch)


def lookup_join(rows: DataFrame, staged: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Join with a staged table: by broadcast up to the byte bound, salted beyond it."""
    if is_small(staged):
        return rows.join(F.broadcast(staged), key, how)
    return salted_join(rows, staged, key, how)
