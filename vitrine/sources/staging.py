"""Staged tables in the cluster's shared folder, and joins that depend on a checked size."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes that a staged side may have in its files to be sent whole to every executor.
MAX_BROADCAST_BYTES = 32 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir`` names; in local mode one is made if it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    context = spark.sparkContext
    folder = context.getCheckpointDir()
    if folder:
        return folder
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="vitrine-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def session_folder(spark: SparkSession) -> str:
    """The application's own part of the shared folder, removed when its JVM ends."""
    context = spark.sparkContext
    folder = f"{shared_folder(spark)}/staged/{context.applicationId}"
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder


def planned_bytes(table: DataFrame) -> int:
    """The planner's size estimate, known without running anything; for a staged table
    that of its files."""
    return int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def stage(table: DataFrame, name: str) -> DataFrame:
    """Write a table once to the shared folder and read it back.

    The copy cuts the lineage, survives lost executors and carries its true size,
    which the planner uses to choose between broadcast and shuffle joins.
    """
    spark = table.sparkSession
    path = f"{session_folder(spark)}/{name}-{uuid.uuid4().hex}"
    table.write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def together(
    spark: SparkSession, **steps: Callable[[], DataFrame]
) -> dict[str, DataFrame]:
    """Run independent steps side by side, so one's short stages fill the other's gaps."""
    if not steps:
        return {}
    inherit = inheritable_thread_target(spark)
    with ThreadPoolExecutor(len(steps)) as pool:
        running = {name: pool.submit(inherit(step)) for name, step in steps.items()}
        return {name: future.result() for name, future in running.items()}


def is_small(staged: DataFrame) -> bool:
    return planned_bytes(staged) <= MAX_BROADCAST_BYTES


def broadcast_if_small(staged: DataFrame) -> DataFrame:
    """Mark a staged table for broadcast when the bytes of its files allow it.

    Above the bound the table is returned unmarked and the join shuffles.
    """
    return F.broadcast(staged) if is_small(staged) else staged
