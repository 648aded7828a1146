"""Structured Streaming counterparts: windowed counts, first-wins de-duplication, running budgets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import shared_dir


def _timed(events: DataFrame, ts: str, late: str) -> DataFrame:
    """With a watermark; times without a zone are taken in the session's."""
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def window_counts(events: DataFrame, ts: str = "ts", by: str = "event_type", size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums; rows later than the watermark are dropped by the engine."""
    return _timed(events, ts, late).groupBy(F.window(ts, size).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def first_seen(events: DataFrame, key: str, ts: str = "ts", late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark; state is dropped as the watermark passes."""
    return _timed(events, ts, late).dropDuplicatesWithinWatermark([key])


def running_budget(events: DataFrame, by: str, key: str, size: str, quota: int) -> DataFrame:
    """Rows of each group until its sizes reach the quota, over all micro-batches: one number of state a group."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    fields = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def take(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(key)
            before = used + frame[size].cumsum() - frame[size]
            kept = frame[before < quota]
            used = int(used + kept[size].sum())
            yield kept[[by, key, size]]
        state.update((used,))

    return events.select(by, key, size).groupBy(by).applyInPandasWithState(take, f"{by} {fields[by]}, {key} {fields[key]}, {size} {fields[size]}", "used long", "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame) -> DataFrame:
    """Run an append stream over what is there, into parquet in the shared folder, and read that back."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/streams/{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/state").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")
