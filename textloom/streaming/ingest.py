"""Structured streams over the same operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from textloom.sources.files import append_new


def append_stream(stream: DataFrame, path: str, key: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Each micro-batch appends the keys that are not there yet, so a replayed batch adds nothing."""

    def write(batch: DataFrame, _: int) -> None:
        append_new(transform(batch) if transform else batch, path, key)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_health(runs: DataFrame, time: str = "run_ts", late: str = "7 days", window: str = "1 day") -> DataFrame:
    """Per window and run: records, failures and mean elapsed; records later than ``late`` are left out."""
    failed = (F.col("error") != 0) | F.col("submitted").isNull()
    return (
        runs.withWatermark(time, late)
        .groupBy(F.window(time, window), "run_id")
        .agg(F.count("*").alias("records"), F.count_if(failed).alias("failures"), F.avg("elapsed").alias("elapsed"))
        .select(F.col("window.start").alias("start"), "run_id", "records", "failures", "elapsed")
    )
