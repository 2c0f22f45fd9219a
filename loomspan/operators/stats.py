"""Statistics over repeated runs: confidence intervals, gates, scores, shares and distributions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Two-sided 95 % quantiles of Student's t by degrees of freedom.
T_TABLE = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 25: 2.060, 30: 2.042, 40: 2.021, 60: 2.000, 80: 1.990, 100: 1.984, 120: 1.980}


def unpivoted(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """Long form: keys, metric, value."""
    return df.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def t_quantile(n: Column) -> Column:
    """The t quantile for a sample of n: by the table, between its entries by a straight line, 1.96 beyond it."""
    dof = n - 1
    known = sorted(T_TABLE)
    out = F.when(dof <= 1, T_TABLE[1])
    for a, b in zip(known, known[1:]):
        out = out.when(dof <= b, F.lit(T_TABLE[a]) + (T_TABLE[b] - T_TABLE[a]) * (dof - a) / F.lit(float(b - a)))
    return out.otherwise(1.96)


def intervals(long: DataFrame, *by: str) -> DataFrame:
    """n, mean, std and the 95 % interval of value per group; a single value has std and width 0."""
    n = F.count("value")
    base = long.groupBy(*by).agg(n.alias("n"), F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"))
    half = F.when(F.col("n") <= 1, 0.0).otherwise(t_quantile(F.col("n")) * F.col("std") / F.sqrt("n"))
    return base.select(*by, "n", F.round("mean", 9).alias("mean"), F.round("std", 6).alias("std"), F.round(F.col("mean") - half, 6).alias("ci95_low"), F.round(F.col("mean") + half, 6).alias("ci95_high"))


def weighted(df: DataFrame, keys: list[str], metrics: list[str], weight: str) -> DataFrame:
    """Means of metrics weighted by a count; a total weight of 0 gives 0."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(total.alias(weight), *(F.round(F.coalesce(F.sum(F.col(m) * F.col(weight)) / F.when(total == 0, 1).otherwise(total), F.lit(0.0)), 6).alias(m) for m in metrics))


def calibration(runs: DataFrame) -> DataFrame:
    """Per method over its runs: means, 1.96 s / sqrt(n) half widths and summed errors."""
    half = lambda c: F.round(1.96 * F.coalesce(F.stddev_samp(c), F.lit(0.0)) / F.sqrt(F.count(c)), 6)
    return runs.groupBy("method").agg(
        F.count("*").alias("n_seeds"), F.round(F.avg("f1"), 9).alias("mean_f1"), half("f1").alias("ci95_f1"), F.round(F.avg("p95_latency_ms"), 9).alias("mean_p95_latency_ms"), half("p95_latency_ms").alias("ci95_p95_latency_ms"),
        F.round(F.avg("avg_steps"), 9).alias("mean_avg_steps"), F.round(F.avg("avg_retrieval"), 9).alias("mean_avg_retrieval"), F.sum("oom_count").alias("oom_sum"),
    )


def ratio(a: Column, b: Column, of_zero: float) -> Column:
    """a / b, or ``of_zero`` where b is 0 or null."""
    return F.when(F.coalesce(b, F.lit(0.0)) == 0, F.lit(of_zero)).otherwise(a / b)


def gate(deltas: DataFrame, least_f1: float = 0.03, most_p95: float = 1.5, most_retrieval: float = 1.8) -> DataFrame:
    """Adds passed and reason to rows of delta_f1, p95_ratio and retrieval_ratio; a missing mean fails."""
    missing = F.col("delta_f1").isNull() | F.col("p95_ratio").isNull() | F.col("retrieval_ratio").isNull()
    reasons = F.array_join(
        F.filter(F.array(F.when(missing, "missing_metric"), F.when(F.col("delta_f1") < least_f1, "delta_f1"), F.when(F.col("p95_ratio") > most_p95, "p95_ratio"), F.when(F.col("retrieval_ratio") > most_retrieval, "retrieval_ratio")), lambda x: x.isNotNull()),
        ";",
    )
    return deltas.withColumn("reason", reasons).withColumn("passed", F.col("reason") == "")


def scores(df: DataFrame, target: float = 0.34, target_single: float = 0.29, target_ratio: float = 1.8) -> DataFrame:
    """Adds score, passed and failure_mode to rows of overall, single, multi, code, baseline_code, ratio and oom.

    The score is a weighted mean of the f1 values less penalties for what misses its
    target. The failure mode is the first that applies.
    """
    under = lambda c, t: F.greatest(F.lit(0.0), F.lit(t) - F.col(c))
    gain = 0.45 * F.col("overall") + 0.25 * F.col("single") + 0.15 * F.col("multi") + 0.15 * F.col("code")
    loss = 0.35 * under("overall", target) + 0.35 * under("single", target_single) + 0.20 * F.greatest(F.lit(0.0), F.col("ratio") - target_ratio) + 0.10 * F.col("oom")
    passed = (F.col("overall") >= target) & (F.col("single") >= target_single) & (F.col("ratio") <= target_ratio) & (F.col("oom") == 0)
    mode = (
        F.when(F.col("oom") > 0, "oom_guard").when(F.col("ratio") > target_ratio, "tail_latency").when(F.col("single") < target_single, "single_doc_recall")
        .when(F.col("multi") <= F.least("single", "code"), "multi_doc_recall").when(F.col("code") < F.col("baseline_code"), "code_recall").otherwise("slow_plateau")
    )
    return df.withColumn("score", F.round(gain - loss, 6)).withColumn("passed", passed).withColumn("failure_mode", mode)


def contributions(deltas: DataFrame) -> DataFrame:
    """Adds each task's share of the total change, delta * n / sum(n), and the running total in task order."""
    share = F.col("delta") * F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(1)))
    df = deltas.withColumn("contribution", share)
    return df.withColumn("running", F.round(F.sum("contribution").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, 0)), 6)).withColumn("contribution", F.round("contribution", 6))


def histogram(df: DataFrame, value: str, low: float, high: float, bins: int, *by: str) -> DataFrame:
    """Counts and densities of equal bins; the last is closed above, values outside are left out."""
    width = (high - low) / bins
    inside = df.where((F.col(value) >= low) & (F.col(value) <= high))
    binned = inside.withColumn("bin", F.least(F.floor((F.col(value) - low) / F.lit(width)), F.lit(bins - 1)).cast("int"))
    counts = binned.groupBy(*by, "bin").agg(F.count("*").alias("n"))
    return counts.withColumn("density", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))) / F.lit(width), 6))


def quartiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    q = F.percentile(F.col(value), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return df.groupBy(*by).agg(q.alias("q"), F.count(value).alias("n")).select(*by, "n", *(F.round(F.col("q")[i], 6).alias(f"q{i + 1}") for i in range(3)))


def ecdf(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Share of values up to each distinct value, from counts per value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*by)
    upto = F.sum("n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return counts.withColumn("share", F.round(upto / F.sum("n").over(w), 6)).drop("n")


def crosstab(df: DataFrame, row: str, column: str, values: Iterable[str]) -> DataFrame:
    """Counts of each row label by the given column values, 0 where there is none, and their total."""
    values = list(values)
    wide = df.groupBy(row).pivot(column, values).count().na.fill(0)
    return wide.withColumn("total", sum((F.col(f"`{v}`") for v in values), F.lit(0)))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keys whose value differs between two tables of key and value; a missing key is null."""
    both = old.select("key", F.col("value").alias("old")).join(new.select("key", F.col("value").alias("new")), "key", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new")))


def label_scores(df: DataFrame, truth: str, said: str, labels: list[str]) -> DataFrame:
    """One row: accuracy and macro F1 over labels; a label never true nor said scores 1, one never hit 0."""
    parts = []
    for label in labels:
        tp, fp, fn = (F.count_if(c) for c in ((F.col(truth) == label) & (F.col(said) == label), (F.col(truth) != label) & (F.col(said) == label), (F.col(truth) == label) & (F.col(said) != label)))
        parts.append(F.when(tp + fp + fn == 0, 1.0).when(tp == 0, 0.0).otherwise(2 * tp / (2 * tp + fp + fn)))
    return df.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg((F.col(truth) == F.col(said)).cast("double")), F.lit(0.0)), 6).alias("accuracy"), F.round(sum(parts, F.lit(0.0)) / len(labels), 6).alias("macro_f1"))


def streaks(df: DataFrame, order: list[str], flag: str, *by: str) -> DataFrame:
    """Adds streak: how many rows up to this one, in order, the flag has been true in a row."""
    w = Window.partitionBy(*by).orderBy(*order)
    broken = F.sum(F.when(F.coalesce(F.col(flag), F.lit(False)), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    df = df.withColumn("_island", broken)
    return df.withColumn("streak", F.sum(F.when(F.coalesce(F.col(flag), F.lit(False)), 1).otherwise(0)).over(Window.partitionBy(*by, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))).drop("_island")


def snapshot_changes(df: DataFrame, order: list[str], value: str, *by: str) -> DataFrame:
    """Rows whose value differs from the one before; the first of each group always stays."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_prev", F.lag(value).over(w)).withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_prev"))).drop("_prev", "_n")


def student_summary(rows: DataFrame, key_tasks: list[str], teacher: str, how: str = "macro") -> DataFrame:
    """``scope, model, n_samples, em, f1, avg_retrieval, avg_latency_ms`` and the last three's and em's deltas to the teacher, per task and for the key tasks together.

    ``rows`` are scored ones with model and task. Key tasks are weighed by their samples
    ('micro') or alike ('macro'); a model without any has zeros. The teacher's own deltas are 0.
    """
    means = {"em": "em", "f1": "f1", "avg_retrieval": "n_retrieval", "avg_latency_ms": "latency_ms.total"}
    per = rows.groupBy("model", F.col("task").alias("scope")).agg(F.count("*").alias("n_samples"), *(F.avg(F.coalesce(F.col(c), F.lit(0)).cast("double")).alias(m) for m, c in means.items()))
    kept = per.where(F.col("scope").isin(key_tasks))
    weight = F.col("n_samples") if how == "micro" else F.lit(1)
    key = kept.groupBy("model").agg(F.sum("n_samples").alias("n_samples"), *((F.sum(F.col(m) * weight) / F.sum(weight)).alias(m) for m in means))
    models = per.select("model").distinct()
    key = models.join(key, "model", "left").select("model", F.lit(f"key_{how}").alias("scope"), F.coalesce("n_samples", F.lit(0)).alias("n_samples"), *(F.coalesce(m, F.lit(0.0)).alias(m) for m in means))
    both = per.unionByName(key)
    base = both.where(F.col("model") == teacher).select("scope", *(F.col(m).alias(f"_{m}") for m in means))
    deltas = [F.round(F.col(m) - F.col(f"_{m}"), 6).alias(f"delta_{m.removeprefix('avg_')}") for m in means]
    return both.join(base, "scope", "left").select("scope", "model", "n_samples", *(F.round(m, 6).alias(m) for m in means), *deltas)


def keyword_hits(searches: DataFrame, found: DataFrame) -> DataFrame:
    """One row: searches and the share of them whose best chunk holds the gold answer; 0 without any.

    ``searches`` has qid and gold; ``found`` qid, text and rank. A search without chunks or
    without gold is no hit.
    """
    first = found.where("rank = 1").select("qid", "text")
    hit = (F.coalesce("gold", F.lit("")) != "") & F.contains(F.coalesce("text", F.lit("")), F.col("gold"))
    return searches.join(first, "qid", "left").agg(F.count("*").alias("n_searches"), F.round(F.coalesce(F.avg(F.coalesce(hit, F.lit(False)).cast("double")), F.lit(0.0)), 6).alias("hit_rate"))
