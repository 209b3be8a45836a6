"""Run logs as JSON files, one folder per experiment."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_SCHEMA = (
    "run_name string, start_time string, end_time string, params map<string,string>, "
    "metrics map<string,double>, tags map<string,string>, _corrupt_record string"
)


def write_runs(runs: DataFrame, path: str) -> None:
    """Append runs under ``path``, a folder per experiment."""
    columns = ["experiment", "run_name", "start_time", "end_time", "params", "metrics", "tags"]
    runs.select(*columns).write.mode("append").partitionBy("experiment").json(path)


def read_runs(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Read run logs; a file or line that is not valid JSON stays as a corrupt row.

    ``multi_line`` reads files that hold one indented object each, as other tools write.
    """
    table = spark.read.schema(RUN_SCHEMA).option("multiLine", multi_line).json(path)
    return table.withColumn("source_file", F.input_file_name()).withColumnRenamed(
        "_corrupt_record", "corrupt_record"
    )
