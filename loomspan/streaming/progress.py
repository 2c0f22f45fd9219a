"""Progress of append-only runs as streams: windows, late rows, stalls and changes."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_appended(spark: SparkSession, folder: str, schema: str = EVENTS, per_trigger: int = 0) -> DataFrame:
    """New Parquet files of a folder as they come."""
    reader = spark.readStream.schema(schema)
    if per_trigger > 0:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(folder)


def throughput(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean value per window and method; rows later than the watermark are dropped."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.window("ts", width), F.col("event_type").alias("method")).agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select("window.start", "window.end", "method", "n", "mean")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Bursts of a worker's rows that end after a gap."""
    kept = events.withWatermark("ts", late)
    return kept.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("session_window.start", "session_window.end", "user_id", "n")


def stalls(events: DataFrame, idle_s: int = 1800, late: str = "10 minutes") -> DataFrame:
    """``user_id, last_ts, n``: a row for each worker of whom nothing came for ``idle_s`` seconds of event time.

    The state of a worker is its last time and count; it is dropped once reported, so a
    worker that comes back counts anew.
    """

    def update(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            last, n = state.get
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "last_ts": [pd.Timestamp(last, unit="ms")], "n": [n]})
            return
        last, n = state.get if state.exists else (0, 0)
        for batch in batches:
            n += len(batch)
            last = max(last, int(batch["ts"].max().timestamp() * 1000))
        state.update((last, n))
        state.setTimeoutTimestamp(max(last + idle_s * 1000, state.getCurrentWatermarkMs() + 1))

    kept = events.where(F.col("ts").isNotNull()).withWatermark("ts", late).groupBy("user_id")
    return kept.applyInPandasWithState(update, "user_id long, last_ts timestamp, n long", "last long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def watch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None):
    """Starts a poller: ``write`` gets each batch and its number; without ``every`` it ends with what is there."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
