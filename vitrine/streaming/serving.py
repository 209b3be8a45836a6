"""The same operators over tables that keep arriving.

Each micro-batch goes through the batch operators against the staged feature tables.  A
batch writes to a folder of its own, in overwrite mode, so a batch that is run again
after a failure replaces its output instead of adding to it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitrine.operators import drift
from vitrine.operators import ranking
from vitrine.sources.staging import stage


def each_batch(
    stream: DataFrame, work: Callable[[DataFrame], DataFrame], output: str, checkpoint: str
) -> StreamingQuery:
    """Run ``work`` on what is there and stop; a later call goes on from the checkpoint."""

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{output}/batch={number}")

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def serve(
    requests: DataFrame, users: DataFrame, catalogue: DataFrame, output: str, checkpoint: str
) -> StreamingQuery:
    """Answer a stream of recommendation requests, each in some way (``ranking.answer``)."""
    return each_batch(
        requests, lambda batch: ranking.answer(batch, users, catalogue), output, checkpoint
    )


def watch_windows(
    rows: DataFrame,
    profile: drift.Profile,
    time: str,
    output: str,
    checkpoint: str,
    length: str = "1 day",
    late: str = "1 hour",
) -> StreamingQuery:
    """Check every window of event time against a fitted profile, once it is complete.

    What is kept between batches is the number of rows per window and bin, in Spark's state
    store, and a window leaves it when the watermark passes its end.  Its alerts are those of a
    batch check of the window's rows, over however many batches they arrived.
    """
    window = F.window(time, length)
    counted = drift.tally(
        profile,
        rows.withWatermark(time, late).withColumn("window", window),
        by=["window"],
    )

    def alerts(batch: DataFrame) -> DataFrame:
        counts = batch.select("window.start", "feature", "part", "n").withColumnRenamed("start", "window_start")
        return drift.check_counts(profile, stage(counts, "closed_windows"), by=["window_start"])

    return each_batch(counted, alerts, output, checkpoint)


def watch(
    rows: DataFrame, profile: drift.Profile, output: str, checkpoint: str
) -> StreamingQuery:
    """Check every micro-batch against a fitted profile."""
    return each_batch(rows, lambda batch: drift.check(profile, batch), output, checkpoint)
