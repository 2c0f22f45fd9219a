"""Scoring of predictions and their summaries by method and task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Columns of every summary, in order.
MEASURES = "em f1 avg_steps avg_retrieval avg_retrieved_chunks_total avg_prompt_tokens_total avg_completion_tokens_total p50_latency_ms p95_latency_ms gpu_peak_mb gpu_mean_mb".split()


def char_f1(df: DataFrame, key: str, pred: str, gold: str) -> DataFrame:
    """Adds f1: overlap of the multisets of scored code points; 1 if both are empty, 0 if one is.

    Arrays of distinct code points are counted within the row, so no row is shuffled.
    """
    p, g = T.scored(F.col(pred)), T.scored(F.col(gold))
    df = df.withColumns({"_p": p, "_g": g})
    df = df.withColumns({"_pc": T.code_points(F.col("_p")), "_gc": T.code_points(F.col("_g"))})
    shared = F.array_intersect("_pc", "_gc")
    count = lambda arr, x: F.size(F.filter(arr, lambda y: y == x))
    common = F.aggregate(shared, F.lit(0), lambda a, x: a + F.least(count(F.col("_pc"), x), count(F.col("_gc"), x)))
    df = df.withColumn("_common", common.cast("double"))
    precision, recall = F.col("_common") / F.size("_pc"), F.col("_common") / F.size("_gc")
    f1 = F.when((F.col("_p") == "") & (F.col("_g") == ""), 1.0).when((F.col("_p") == "") | (F.col("_g") == "") | (F.col("_common") == 0), 0.0).otherwise(2 * precision * recall / (precision + recall))
    return df.withColumn("f1", f1).drop("_p", "_g", "_pc", "_gc", "_common")


def scored_rows(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Predictions with em and f1; gold and task from the gold table by id, else the row's own gold and 'unknown'."""
    known = gold.select("id", F.col("answer").alias("_answer"), F.col("task").alias("_task"), F.lit(True).alias("_known"))
    joined = preds.join(known, "id", "left").withColumn("gold", F.when(F.col("_known"), F.col("_answer")).otherwise(F.col("gold"))).withColumn("task", F.coalesce("_task", F.lit("unknown")))
    joined = joined.withColumn("em", T.exact_match(F.col("pred"), F.col("gold")))
    return char_f1(joined.drop("_answer", "_task", "_known"), "id", "pred", "gold")


def best_over_gold(df: DataFrame, key: str, pred: str, golds: str) -> DataFrame:
    """``key, em, f1``: the best of each over a list of golds, independently."""
    one = df.select(key, pred, F.explode(golds).alias("_gold")).withColumn("em", T.exact_match(F.col(pred), F.col("_gold")))
    return char_f1(one, key, pred, "_gold").groupBy(key).agg(F.max("em").alias("em"), F.max("f1").alias("f1"))


def _mean(c: str) -> Column:
    return F.coalesce(F.avg(F.coalesce(c, F.lit(0)).cast("double")), F.lit(0.0))


def aggregates() -> list[Column]:
    """The summary of a group of scored rows; nulls count as 0."""
    total = F.coalesce(F.col("latency_ms.total"), F.lit(0.0))
    modes = F.collect_set(F.coalesce("backend_mode", F.lit("unknown")))
    mode = F.when(F.size(modes) == 1, modes[0]).when(F.size(modes) > 1, "mixed").otherwise("unknown")
    return [
        F.count("*").alias("n_samples"),
        mode.alias("backend_mode"),
        F.round(_mean("em"), 6).alias("em"),
        F.round(_mean("f1"), 6).alias("f1"),
        F.round(_mean("n_steps"), 6).alias("avg_steps"),
        F.round(_mean("n_retrieval"), 6).alias("avg_retrieval"),
        F.round(_mean("retrieved_chunks_total"), 6).alias("avg_retrieved_chunks_total"),
        F.round(_mean("prompt_tokens_total"), 6).alias("avg_prompt_tokens_total"),
        F.round(_mean("completion_tokens_total"), 6).alias("avg_completion_tokens_total"),
        F.round(F.coalesce(F.percentile(total, 0.5), F.lit(0.0)), 6).alias("p50_latency_ms"),
        F.round(F.coalesce(F.percentile(total, 0.95), F.lit(0.0)), 6).alias("p95_latency_ms"),
        F.round(F.coalesce(F.max("gpu_mem_mb.peak"), F.lit(0.0)), 6).alias("gpu_peak_mb"),
        F.round(_mean("gpu_mem_mb.mean"), 6).alias("gpu_mean_mb"),
        F.count_if(F.coalesce("error_count", F.lit(0)) > 0).alias("oom_count"),
    ]


def summary(rows: DataFrame, *by: str) -> DataFrame:
    """One row of aggregates per group; without groups one row even of an empty table."""
    return rows.groupBy(*by).agg(*aggregates()) if by else rows.agg(*aggregates())


def macro(per_task: DataFrame, tasks: list[str], *by: str) -> DataFrame:
    """Unweighted means of the tasks' values, percentiles and peaks included; counts are added up."""
    kept = per_task.where(F.col("task").isin(tasks))
    return kept.groupBy(*by).agg(F.count("*").alias("n_tasks"), F.sum("n_samples").alias("n_samples"), *(F.round(F.avg(m), 9).alias(m) for m in MEASURES), F.sum("oom_count").alias("oom_count"))


def error_cases(rows: DataFrame, below: float = 0.2) -> DataFrame:
    """Rows whose f1 is strictly below the bound."""
    return rows.where(F.col("f1") < below)


def series_stats(df: DataFrame) -> DataFrame:
    """Adds series_peak and series_mean of gpu_mem_mb.series; 0 of an empty or null series."""
    s = F.col("gpu_mem_mb.series")
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.coalesce(x, F.lit(0.0)))
    return df.withColumns({"series_peak": F.coalesce(F.array_max(s), F.lit(0.0)), "series_mean": F.when(F.size(s) > 0, total / F.size(s)).otherwise(0.0)})
