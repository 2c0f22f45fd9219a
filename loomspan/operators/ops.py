"""Sharded runs: plans, progress, stages, stalls and configuration changes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shard_plan(totals: DataFrame, size: int = 170) -> DataFrame:
    """``method, shard, start, end, expected`` for each method's total number of rows."""
    starts = F.when(F.col("total") > 0, F.sequence(F.lit(0), F.col("total") - 1, F.lit(size))).otherwise(F.array().cast("array<bigint>"))
    rows = totals.select("method", "total", F.posexplode(starts).alias("shard", "start"))
    end = F.least(F.col("start") + size, F.col("total"))
    return rows.select("method", F.col("shard").cast("long").alias("shard"), F.col("start").cast("long").alias("start"), end.cast("long").alias("end"), (end - F.col("start")).cast("long").alias("expected"))


def shard_status(plan: DataFrame, done: DataFrame, retries: int = 2) -> DataFrame:
    """Adds out_lines, attempts and status to a plan.

    Complete once all lines are there, whatever else; failed beyond the retries; else to be
    retried if anything was tried, or pending.
    """
    joined = plan.join(done, ["method", "shard"], "left").withColumns({"out_lines": F.coalesce("out_lines", F.lit(0)).cast("long"), "attempts": F.coalesce("attempts", F.lit(0)).cast("long")})
    status = F.when(F.col("out_lines") == F.col("expected"), "completed").when(F.col("attempts") > retries, "failed").when((F.col("out_lines") > 0) | (F.col("attempts") > 0), "retry_pending").otherwise("pending")
    return joined.withColumn("status", status)


def pending_order(status: DataFrame) -> DataFrame:
    """Shards still to run with their place: retries first, then by start."""
    todo = status.where(F.col("status").isin("retry_pending", "pending"))
    w = Window.partitionBy("method").orderBy(F.when(F.col("status") == "retry_pending", 0).otherwise(1), "start")
    return todo.withColumn("place", F.row_number().over(w))


def progress(status: DataFrame) -> DataFrame:
    """Per method: shards, completed and failed ones, lines and their share."""
    return status.groupBy("method").agg(
        F.count("*").alias("shards"), F.count_if(F.col("status") == "completed").alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum("out_lines").alias("lines"),
        F.round(F.sum("out_lines") / F.sum("expected"), 6).alias("share"), (F.count_if(F.col("status") != "completed") == 0).alias("mergeable"),
    )


def stage(done: Column, running: Column, failed: Column, merged: Column) -> Column:
    """not_started, running, blocked, waiting_merge, partial or finished."""
    return (
        F.when(merged, "finished").when(failed > 0, "blocked").when(running > 0, "running").when((done > 0) & (running == 0), "waiting_merge").when(done > 0, "partial").otherwise("not_started")
    )


def stalls(events: DataFrame, now: Column, idle: int = 1800, *by: str) -> DataFrame:
    """Per group: last event, seconds since then, and whether that is a stall. Null times don't count."""
    last = events.groupBy(*by).agg(F.max("ts").alias("last_ts"))
    seconds = F.timestamp_diff("SECOND", F.col("last_ts"), now)
    return last.withColumn("idle_s", seconds).withColumn("stalled", F.coalesce(seconds >= idle, F.lit(True)))


def anomalies(status: DataFrame, notes: list[str] | None = None) -> DataFrame:
    """Shards that failed or wait for another try, complete ones that took one, and ones whose note has one of ``notes`` in it, with the reason."""
    reason = F.when(F.col("status") == "failed", "failed").when(F.col("status") == "retry_pending", "retry").when((F.col("status") == "completed") & (F.col("attempts") > 1), "late")
    for note in notes or []:
        reason = reason.when(F.contains(F.lower(F.coalesce("note", F.lit(""))), F.lit(note.lower())), f"note: {note}")
    return status.withColumn("reason", reason).where(F.col("reason").isNotNull())


def transitions(events: DataFrame, retries: int = 2) -> DataFrame:
    """``method, shard, at, was, status``: each change of a shard's state, in order of its events.

    ``events`` has method, shard, at, event ('start' or 'exit'), expected and out_lines. A
    start makes a shard running, or retry_pending first if lines are there already; an
    exit completes it if all lines are there, whatever its code, else it waits for another
    try or, beyond the retries, has failed.
    """
    w = Window.partitionBy("method", "shard").orderBy("at")
    tries = F.count_if(F.col("event") == "start").over(w.rowsBetween(Window.unboundedPreceding, 0))
    whole = F.col("out_lines") == F.col("expected")
    ended = F.when(whole, "completed").when(tries <= retries, "retry_pending").otherwise("failed")
    begun = F.when(whole, "completed").when((F.col("out_lines") > 0) & (tries == 1), "retry_pending").otherwise("running")
    named = events.withColumn("status", F.when(F.col("event") == "start", begun).otherwise(ended))
    named = named.withColumn("was", F.coalesce(F.lag("status").over(w), F.lit("pending")))
    return named.where(F.col("was") != F.col("status")).select("method", "shard", "at", "was", "status")


def flattened(config: Mapping, most: int = 8) -> dict[str, str]:
    """A nested configuration as dotted keys and text values; a longer list is summarised by its length."""
    out: dict[str, str] = {}

    def walk(prefix: str, value) -> None:
        if isinstance(value, Mapping):
            for k in sorted(value):
                walk(f"{prefix}.{k}" if prefix else str(k), value[k])
        elif isinstance(value, (list, tuple)) and len(value) > most:
            out[prefix] = f"[{len(value)} items]"
        else:
            out[prefix] = str(value)

    walk("", config)
    return out


def config_frame(spark: SparkSession, config: Mapping) -> DataFrame:
    return spark.createDataFrame(sorted(flattened(config).items()), "key string, value string")


def limited(df: DataFrame, key: str, most: int) -> DataFrame:
    """``line``: the first keys in order and, if there are more, a line that counts them."""
    first = df.select(key).orderBy(key).limit(most)
    rest = df.agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.format_string("... and %d more", F.col("n") - most).alias("line"))
    return first.select(F.col(key).alias("line")).unionByName(rest)


def report_lines(status: DataFrame) -> DataFrame:
    """``method, report``: one fixed line per shard, in order."""
    line = F.format_string("%s[%d] %d-%d %s %d/%d", "method", "shard", "start", "end", "status", "out_lines", "expected")
    listed = F.array_sort(F.collect_list(F.struct("shard", line.alias("l"))))
    return status.groupBy("method").agg(listed.alias("x")).select("method", F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("report"))
