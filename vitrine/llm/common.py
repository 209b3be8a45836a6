"""What several of the text operators share."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows of an Arrow batch that a Python task works on at a time.
PORTION = 512
# Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
# Most bytes of a table that is sent whole to every executor.
BROADCAST_BYTES = 32 << 20


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def text_key() -> Column:
    """Tells apart rows that share a doc_id; rows alike in both are one document."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def broadcast_below(staged: DataFrame, row_bytes: int | Column) -> DataFrame:
    """Mark a staged table for broadcast if its size fits the bound.

    The size is the row count from the footers times a fixed width, or a sum of widths.
    Beyond the bound the table is returned as it is and the join shuffles.
    """
    if isinstance(row_bytes, int):
        total = staged.count() * row_bytes
    else:
        total = staged.agg(F.sum(row_bytes)).first()[0] or 0
    return F.broadcast(staged) if total <= BROADCAST_BYTES else staged


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, where repeating it would compute it again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def portions(batches: Iterator, rows: int = PORTION) -> Iterator:
    """The batches in small pieces, so that what is made of a piece stays small."""
    for batch in batches:
        for low in range(0, batch.num_rows, rows):
            yield batch.slice(low, rows)


def map_batches(frame: DataFrame, function, ddl: str, *more) -> DataFrame:
    """``mapInArrow`` of a function of (batches, Arrow schema of the result, more)."""
    struct = StructType.fromDDL(ddl)
    schema = to_arrow_schema(struct)
    return frame.mapInArrow(lambda batches: function(batches, schema, *more), struct)


def record_batch(columns: list, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [pa.array(values, field.type) for values, field in zip(columns, schema)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)
