"""Scoring and run statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import metrics, stats
from ..registry import query
from .base import PREDS, SAMPLES, preds, samples, sql_chars, sql_scored

KEY = ["multi_doc_qa", "code_qa"]
_KEY = "('multi_doc_qa', 'code_qa')"

#: DuckDB's text for f1 of two scored texts p and g.
_F1 = (
    f"CASE WHEN p = '' AND g = '' THEN 1.0 WHEN p = '' OR g = '' THEN 0.0 ELSE (SELECT CASE WHEN coalesce(sum(least(a.n, b.n)), 0) = 0 THEN 0.0 ELSE 2 * (sum(least(a.n, b.n)) / length(p)::DOUBLE) * (sum(least(a.n, b.n)) / length(g)::DOUBLE) / (sum(least(a.n, b.n)) / length(p)::DOUBLE + sum(least(a.n, b.n)) / length(g)::DOUBLE) END "
    f"FROM (SELECT c, count(*) AS n FROM (SELECT unnest({sql_chars('p')}) AS c) GROUP BY c) a JOIN (SELECT c, count(*) AS n FROM (SELECT unnest({sql_chars('g')}) AS c) GROUP BY c) b USING (c)) END"
)
ROWS = (
    f"{SAMPLES}, {PREDS}, joined AS (SELECT b.* EXCLUDE (gold), CASE WHEN s.id IS NOT NULL THEN s.answer ELSE b.gold END AS gold, coalesce(s.task, 'unknown') AS task FROM preds b LEFT JOIN samples s USING (id)), "
    f"pg AS (SELECT *, {sql_scored('pred')} AS p, {sql_scored('gold')} AS g FROM joined), rows AS (SELECT *, (p = g)::INT::DOUBLE AS em, ({_F1})::DOUBLE AS f1 FROM pg)"
)
AGG = (
    "count(*) AS n_samples, CASE WHEN count(DISTINCT coalesce(backend_mode, 'unknown')) = 1 THEN min(coalesce(backend_mode, 'unknown')) WHEN count(*) > 0 THEN 'mixed' ELSE 'unknown' END AS backend_mode, "
    "round(coalesce(avg(em), 0), 6) AS em, round(coalesce(avg(f1), 0), 6) AS f1, round(coalesce(avg(coalesce(n_steps, 0)), 0), 6) AS avg_steps, round(coalesce(avg(coalesce(n_retrieval, 0)), 0), 6) AS avg_retrieval, "
    "round(coalesce(avg(coalesce(retrieved_chunks_total, 0)), 0), 6) AS avg_retrieved_chunks_total, round(coalesce(avg(coalesce(prompt_tokens_total, 0)), 0), 6) AS avg_prompt_tokens_total, round(coalesce(avg(coalesce(completion_tokens_total, 0)), 0), 6) AS avg_completion_tokens_total, "
    "round(coalesce(quantile_cont(coalesce(latency_ms.total, 0.0), 0.5), 0), 6) AS p50_latency_ms, round(coalesce(quantile_cont(coalesce(latency_ms.total, 0.0), 0.95), 0), 6) AS p95_latency_ms, round(coalesce(max(gpu_mem_mb.peak), 0), 6) AS gpu_peak_mb, round(coalesce(avg(coalesce(gpu_mem_mb.mean, 0)), 0), 6) AS gpu_mean_mb, "
    "count_if(coalesce(error_count, 0) > 0)::BIGINT AS oom_count"
)
_AVGS = ", ".join(f"round(avg({m}), 9) AS {m}" for m in metrics.MEASURES)
#: A method and a seed for each prediction, where the table has one run only.
METHOD, SEED = "CASE WHEN n_retrieval > 1 THEN 'agent' ELSE 'baseline' END", "'seed_' || (length(id) + n_steps) % 3"
_RUNS = f"runs AS (SELECT {METHOD} AS method, {SEED} AS run_tag, task, {AGG} FROM rows GROUP BY ALL)"


def rows(spark, d):
    return metrics.scored_rows(preds(spark, d), samples(spark, d))


def runs(spark, d):
    own = rows(spark, d).withColumns({"method": F.expr(METHOD), "run_tag": F.concat(F.lit("seed_"), (F.length("id") + F.col("n_steps")) % 3)})
    return metrics.summary(own, "method", "run_tag", "task")


@query(f"WITH {ROWS} SELECT id, task, em, round(f1, 6) AS f1 FROM rows")
def char_f1(spark, d):
    return rows(spark, d).select("id", "task", "em", F.round("f1", 6).alias("f1"))


@query(f"WITH {PREDS} SELECT id, ({sql_scored('pred')} = {sql_scored('gold')})::INT::DOUBLE AS em FROM preds")
def exact_match(spark, d):
    return preds(spark, d).select("id", T.exact_match(F.col("pred"), F.col("gold")).alias("em"))


@query(
    f"WITH {SAMPLES}, {PREDS}, l AS (SELECT b.id, b.pred, unnest([b.gold, s.answer]) AS gold FROM preds b JOIN samples s USING (id)), pg AS (SELECT id, {sql_scored('pred')} AS p, {sql_scored('gold')} AS g FROM l) "
    f"SELECT id, max((p = g)::INT::DOUBLE) AS em, round(max(({_F1})::DOUBLE), 6) AS f1 FROM pg GROUP BY id"
)
def best_over_gold(spark, d):
    own = preds(spark, d).join(samples(spark, d).select("id", "answer"), "id").select("id", "pred", F.array("gold", "answer").alias("golds"))
    return metrics.best_over_gold(own, "id", "pred", "golds").withColumn("f1", F.round("f1", 6))


@query(f"WITH {ROWS} SELECT {AGG} FROM rows")
def overall_metrics(spark, d):
    return metrics.summary(rows(spark, d))


@query(f"WITH {ROWS} SELECT task, {AGG} FROM rows GROUP BY task")
def task_metrics(spark, d):
    return metrics.summary(rows(spark, d), "task")


@query(f"WITH {ROWS} SELECT {AGG} FROM rows WHERE task IN {_KEY}")
def key_micro(spark, d):
    return metrics.summary(rows(spark, d).where(F.col("task").isin(KEY)))


@query(f"WITH {ROWS}, t AS (SELECT task, {AGG} FROM rows GROUP BY task) SELECT 1 AS one, count(*) AS n_tasks, sum(n_samples)::BIGINT AS n_samples, {_AVGS}, sum(oom_count)::BIGINT AS oom_count FROM t WHERE task IN {_KEY}")
def key_macro(spark, d):
    per_task = metrics.summary(rows(spark, d), "task").withColumn("one", F.lit(1))
    return metrics.macro(per_task, KEY, "one")


@query(f"WITH {ROWS} SELECT id, pred, gold, round(f1, 6) AS f1 FROM rows WHERE f1 < 0.2")
def error_cases(spark, d):
    return metrics.error_cases(rows(spark, d)).select("id", "pred", "gold", F.round("f1", 6).alias("f1"))


@query(f"WITH {PREDS} SELECT id, coalesce(list_max(gpu_mem_mb.series), 0.0) AS series_peak, round(coalesce(list_avg(gpu_mem_mb.series), 0.0), 6) AS series_mean FROM preds")
def gpu_series(spark, d):
    return metrics.series_stats(preds(spark, d)).select("id", "series_peak", F.round("series_mean", 6).alias("series_mean"))


@query(f"WITH {ROWS}, {_RUNS} SELECT method, run_tag, sum(n_samples)::BIGINT AS n_samples, round(sum(f1 * n_samples) / sum(n_samples), 6) AS f1, round(sum(p95_latency_ms * n_samples) / sum(n_samples), 6) AS p95_latency_ms, round(sum(avg_retrieval * n_samples) / sum(n_samples), 6) AS avg_retrieval FROM runs GROUP BY ALL")
def seed_micro(spark, d):
    return stats.weighted(runs(spark, d), ["method", "run_tag"], ["f1", "p95_latency_ms", "avg_retrieval"], "n_samples")


@query(f"WITH {ROWS}, {_RUNS} SELECT method, run_tag, round(avg(f1), 9) AS f1, round(avg(em), 9) AS em, round(avg(p95_latency_ms), 9) AS p95_latency_ms FROM runs WHERE task IN {_KEY} GROUP BY ALL")
def seed_macro(spark, d):
    return runs(spark, d).where(F.col("task").isin(KEY)).groupBy("method", "run_tag").agg(*(F.round(F.avg(m), 9).alias(m) for m in ("f1", "em", "p95_latency_ms")))


_LONG = "long AS (SELECT method, run_tag, task, unnest(['em', 'f1', 'avg_steps', 'avg_retrieval', 'p50_latency_ms', 'p95_latency_ms', 'gpu_peak_mb']) AS metric, unnest([em, f1, avg_steps, avg_retrieval, p50_latency_ms, p95_latency_ms, gpu_peak_mb]) AS value FROM runs)"
_SEVEN = "em f1 avg_steps avg_retrieval p50_latency_ms p95_latency_ms gpu_peak_mb".split()


@query(f"WITH {ROWS}, {_RUNS}, {_LONG} SELECT * FROM long")
def unpivot_long(spark, d):
    return stats.unpivoted(runs(spark, d), ["method", "run_tag", "task"], _SEVEN)


_KNOWN = sorted(stats.T_TABLE)
_TQ = "CASE WHEN n <= 2 THEN 12.706::DOUBLE " + " ".join(f"WHEN n - 1 <= {b} THEN {stats.T_TABLE[a]}::DOUBLE + ({stats.T_TABLE[b]}::DOUBLE - {stats.T_TABLE[a]}::DOUBLE) * (n - 1 - {a}) / {float(b - a)}::DOUBLE" for a, b in zip(_KNOWN, _KNOWN[1:])) + " ELSE 1.96::DOUBLE END"


@query(
    f"WITH {ROWS}, {_RUNS}, {_LONG}, a AS (SELECT method, metric, count(value) AS n, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s FROM long GROUP BY ALL), h AS (SELECT *, CASE WHEN n <= 1 THEN 0 ELSE ({_TQ}) * s / sqrt(n) END AS h FROM a) "
    "SELECT method, metric, n, round(m, 9) AS mean, round(s, 6) AS std, round(m - h, 6) AS ci95_low, round(m + h, 6) AS ci95_high FROM h"
)
def seed_ci(spark, d):
    return stats.intervals(stats.unpivoted(runs(spark, d), ["method", "run_tag", "task"], _SEVEN), "method", "metric")


@query(
    f"WITH {ROWS}, {_RUNS} SELECT method, count(*) AS n_seeds, round(avg(f1), 9) AS mean_f1, round(1.96 * coalesce(stddev_samp(f1), 0) / sqrt(count(f1)), 6) AS ci95_f1, round(avg(p95_latency_ms), 9) AS mean_p95_latency_ms, round(1.96 * coalesce(stddev_samp(p95_latency_ms), 0) / sqrt(count(p95_latency_ms)), 6) AS ci95_p95_latency_ms, "
    "round(avg(avg_steps), 9) AS mean_avg_steps, round(avg(avg_retrieval), 9) AS mean_avg_retrieval, sum(oom_count)::BIGINT AS oom_sum FROM runs GROUP BY method"
)
def calibration_ci(spark, d):
    return stats.calibration(runs(spark, d))


_PIVOT = "wide AS (SELECT task, sum(n_samples) AS n, sum(f1 * n_samples) FILTER (method = 'baseline') / nullif(sum(n_samples) FILTER (method = 'baseline'), 0) AS baseline, sum(f1 * n_samples) FILTER (method = 'agent') / nullif(sum(n_samples) FILTER (method = 'agent'), 0) AS agent FROM runs GROUP BY task)"


def _wide(spark, d):
    own = runs(spark, d)
    per = lambda m: F.sum(F.when(F.col("method") == m, F.col("f1") * F.col("n_samples"))) / F.sum(F.when(F.col("method") == m, F.col("n_samples")))
    return own.groupBy("task").agg(F.sum("n_samples").alias("n"), per("baseline").alias("baseline"), per("agent").alias("agent"))


@query(f"WITH {ROWS}, {_RUNS}, {_PIVOT} SELECT task, round(baseline, 6) AS baseline, round(agent, 6) AS agent, round(agent - baseline, 6) AS delta FROM wide")
def task_delta_pivot(spark, d):
    return _wide(spark, d).select("task", F.round("baseline", 6).alias("baseline"), F.round("agent", 6).alias("agent"), F.round(F.col("agent") - F.col("baseline"), 6).alias("delta"))


@query(f"WITH {ROWS}, {_RUNS}, {_PIVOT}, c AS (SELECT task, n::BIGINT AS n, coalesce(agent - baseline, 0) AS delta FROM wide), k AS (SELECT task, n, delta * n / sum(n) OVER () AS k FROM c) SELECT task, n, round(k, 6) AS contribution, round(sum(k) OVER (ORDER BY task ROWS UNBOUNDED PRECEDING), 6) AS running FROM k")
def weighted_contribution(spark, d):
    deltas = _wide(spark, d).select("task", "n", F.coalesce(F.col("agent") - F.col("baseline"), F.lit(0.0)).alias("delta"))
    return stats.contributions(deltas).select("task", "n", "contribution", "running")


@query(f"WITH {ROWS}, m AS (SELECT {METHOD} AS method, {AGG} FROM rows GROUP BY ALL) SELECT round(coalesce(a.p95_latency_ms / nullif(b.p95_latency_ms, 0), 0), 6) AS p95_ratio, round(coalesce(a.avg_retrieval / nullif(b.avg_retrieval, 0), 0), 6) AS retrieval_ratio, round(coalesce(a.avg_prompt_tokens_total / nullif(b.avg_prompt_tokens_total, 0), 0), 6) AS token_ratio, a.oom_count AS oom FROM m a JOIN m b ON a.method = 'agent' AND b.method = 'baseline'")
def burden_ratios(spark, d):
    both = metrics.summary(rows(spark, d).withColumn("method", F.expr(METHOD)), "method")
    a, b = both.where("method = 'agent'").alias("a"), both.where("method = 'baseline'").alias("b")
    r = lambda c: F.round(F.coalesce(stats.ratio(F.col(f"a.{c}"), F.col(f"b.{c}"), 0.0), F.lit(0.0)), 6)
    return a.join(F.broadcast(b), F.lit(True)).select(r("p95_latency_ms").alias("p95_ratio"), r("avg_retrieval").alias("retrieval_ratio"), r("avg_prompt_tokens_total").alias("token_ratio"), F.col("a.oom_count").alias("oom"))


_MEANS = f"m AS (SELECT method, run_tag, avg(f1) AS f1, avg(p95_latency_ms) AS p95, avg(avg_retrieval) AS ret FROM runs WHERE task IN {_KEY} GROUP BY ALL), g AS (SELECT a.run_tag, a.f1 - b.f1 AS delta_f1, CASE WHEN b.p95 = 0 THEN 'inf'::DOUBLE ELSE a.p95 / b.p95 END AS p95_ratio, CASE WHEN b.ret = 0 THEN 'inf'::DOUBLE ELSE a.ret / b.ret END AS retrieval_ratio FROM m a LEFT JOIN m b ON a.run_tag = b.run_tag AND b.method = 'baseline' WHERE a.method = 'agent')"


@query(
    f"WITH {ROWS}, {_RUNS}, {_MEANS} SELECT run_tag, concat_ws(';', CASE WHEN delta_f1 IS NULL OR p95_ratio IS NULL OR retrieval_ratio IS NULL THEN 'missing_metric' END, CASE WHEN delta_f1 < 0.03 THEN 'delta_f1' END, CASE WHEN p95_ratio > 1.5 THEN 'p95_ratio' END, CASE WHEN retrieval_ratio > 1.8 THEN 'retrieval_ratio' END) AS reason, "
    "NOT (delta_f1 IS NULL OR p95_ratio IS NULL OR retrieval_ratio IS NULL OR delta_f1 < 0.03 OR p95_ratio > 1.5 OR retrieval_ratio > 1.8) AS passed FROM g"
)
def decision_gate(spark, d):
    means = runs(spark, d).where(F.col("task").isin(KEY)).groupBy("method", "run_tag").agg(F.avg("f1").alias("f1"), F.avg("p95_latency_ms").alias("p95"), F.avg("avg_retrieval").alias("ret"))
    a, b = means.where("method = 'agent'").alias("a"), means.where("method = 'baseline'").alias("b")
    inf = float("inf")
    deltas = a.join(b, F.col("a.run_tag") == F.col("b.run_tag"), "left").select(
        "a.run_tag", (F.col("a.f1") - F.col("b.f1")).alias("delta_f1"), F.when(F.col("b.p95").isNotNull(), stats.ratio(F.col("a.p95"), F.col("b.p95"), inf)).alias("p95_ratio"), F.when(F.col("b.ret").isNotNull(), stats.ratio(F.col("a.ret"), F.col("b.ret"), inf)).alias("retrieval_ratio")
    )
    return stats.gate(deltas).select("run_tag", "reason", "passed")


_POINTS = (
    "pts AS (SELECT run_tag, sum(f1 * n_samples) / sum(n_samples) AS overall, coalesce(avg(f1) FILTER (task = 'single_doc_qa'), 0) AS single, coalesce(avg(f1) FILTER (task = 'multi_doc_qa'), 0) AS multi, coalesce(avg(f1) FILTER (task = 'code_qa'), 0) AS code, 0.5::DOUBLE AS baseline_code, max(p95_latency_ms) / 25000.0 AS ratio, sum(oom_count)::DOUBLE AS oom FROM runs GROUP BY run_tag)"
)


@query(
    f"WITH {ROWS}, {_RUNS}, {_POINTS} SELECT run_tag, round(0.45 * overall + 0.25 * single + 0.15 * multi + 0.15 * code - (0.35 * greatest(0, 0.34 - overall) + 0.35 * greatest(0, 0.29 - single) + 0.20 * greatest(0, ratio - 1.8) + 0.10 * oom), 6) AS score, "
    "overall >= 0.34 AND single >= 0.29 AND ratio <= 1.8 AND oom = 0 AS passed, CASE WHEN oom > 0 THEN 'oom_guard' WHEN ratio > 1.8 THEN 'tail_latency' WHEN single < 0.29 THEN 'single_doc_recall' WHEN multi <= least(single, code) THEN 'multi_doc_recall' WHEN code < baseline_code THEN 'code_recall' ELSE 'slow_plateau' END AS failure_mode FROM pts"
)
def score_failure_mode(spark, d):
    mean = lambda t: F.coalesce(F.avg(F.when(F.col("task") == t, F.col("f1"))), F.lit(0.0))
    points = runs(spark, d).groupBy("run_tag").agg(
        (F.sum(F.col("f1") * F.col("n_samples")) / F.sum("n_samples")).alias("overall"), mean("single_doc_qa").alias("single"), mean("multi_doc_qa").alias("multi"), mean("code_qa").alias("code"), F.lit(0.5).alias("baseline_code"), (F.max("p95_latency_ms") / 25000.0).alias("ratio"), F.sum("oom_count").cast("double").alias("oom")
    )
    return stats.scores(points).select("run_tag", "score", "passed", "failure_mode")


@query(f"WITH {ROWS}, {_RUNS} SELECT run_tag, method, round(avg(f1), 9) AS combo_f1 FROM runs WHERE task IN {_KEY} GROUP BY ALL")
def high_value_combo(spark, d):
    return runs(spark, d).where(F.col("task").isin(KEY)).groupBy("run_tag", "method").agg(F.round(F.avg("f1"), 9).alias("combo_f1"))


@query(f"WITH {ROWS}, e AS (SELECT regexp_extract(id, '^lb_(.*)_[0-9]+_[a-z]+_[0-9]+$', 1) AS dataset, {METHOD} AS method FROM rows WHERE f1 < 0.2) SELECT dataset, count_if(method = 'agent')::BIGINT AS agent, count_if(method = 'baseline')::BIGINT AS baseline, count(*) AS total FROM e GROUP BY dataset")
def error_crosstab(spark, d):
    wrong = metrics.error_cases(rows(spark, d)).select(F.regexp_extract("id", r"^lb_(.*)_[0-9]+_[a-z]+_[0-9]+$", 1).alias("dataset"), F.expr(METHOD).alias("method"))
    return stats.crosstab(wrong, "dataset", "method", ["agent", "baseline"])


@query(f"WITH {ROWS}, b AS (SELECT task, least(floor((f1 - 0.0) / 0.025), 15)::INT AS bin FROM rows WHERE f1 >= 0 AND f1 <= 0.4), c AS (SELECT task, bin, count(*) AS n FROM b GROUP BY ALL) SELECT *, round(n / sum(n) OVER (PARTITION BY task) / 0.025, 6) AS density FROM c")
def error_histogram(spark, d):
    return stats.histogram(rows(spark, d), "f1", 0.0, 0.4, 16, "task")


@query(f"WITH {ROWS} SELECT task, {METHOD} AS method, count(f1) AS n, round(quantile_cont(f1, 0.25), 6) AS q1, round(quantile_cont(f1, 0.5), 6) AS q2, round(quantile_cont(f1, 0.75), 6) AS q3 FROM rows GROUP BY ALL")
def box_stats(spark, d):
    return stats.quartiles(rows(spark, d).withColumn("method", F.expr(METHOD)), "f1", "task", "method")


@query(f"WITH {ROWS}, l AS (SELECT task, round(latency_ms.total, 3) AS v, count(*) AS n FROM rows GROUP BY ALL) SELECT task, v, round(sum(n) OVER (PARTITION BY task ORDER BY v NULLS FIRST ROWS UNBOUNDED PRECEDING) / sum(n) OVER (PARTITION BY task), 6) AS share FROM l")
def ecdf(spark, d):
    own = rows(spark, d).select("task", F.round("latency_ms.total", 3).alias("v"))
    return stats.ecdf(own, "v", "task")


@query(f"WITH {ROWS}, s AS (SELECT id, task, n_retrieval > 1 AS said, prompt_tokens_total > 2500 AS truth FROM rows WHERE prompt_tokens_total IS NOT NULL), c AS (SELECT count(*) AS n, avg((said = truth)::INT) AS a, count_if(said AND truth) AS tp, count_if(said AND NOT truth) AS fp, count_if(truth AND NOT said) AS fn, count_if(NOT said AND NOT truth) AS tn FROM s) SELECT n, round(coalesce(a, 0), 6) AS accuracy, round((CASE WHEN tp + fp + fn = 0 THEN 1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END + CASE WHEN tn + fp + fn = 0 THEN 1.0 WHEN tn = 0 THEN 0.0 ELSE 2.0 * tn / (2 * tn + fp + fn) END) / 2, 6) AS macro_f1 FROM c")
def trigger_macro_f1(spark, d):
    own = rows(spark, d).where(F.col("prompt_tokens_total").isNotNull())
    label = lambda c: F.when(c, "search").otherwise("final")
    said = own.select(label(F.col("n_retrieval") > 1).alias("said"), label(F.col("prompt_tokens_total") > 2500).alias("truth"))
    return stats.label_scores(said, "truth", "said", ["search", "final"])


@query(f"WITH {ROWS}, {_RUNS}, s AS (SELECT run_tag, avg(f1) AS f1, avg(f1) FILTER (task = 'single_doc_qa') AS single, max(p95_latency_ms) / 25000.0 AS ratio, sum(oom_count) AS oom FROM runs GROUP BY run_tag) SELECT round(avg(f1), 9) AS mean_f1, round(avg(single), 9) AS mean_single, round(avg(ratio), 9) AS mean_ratio, sum(oom)::BIGINT AS oom_sum, avg(f1) >= 0.34 AND avg(single) >= 0.29 AND avg(ratio) <= 1.8 AND sum(oom) = 0 AS passed FROM s")
def multi_seed_confirm(spark, d):
    per = runs(spark, d).groupBy("run_tag").agg(F.avg("f1").alias("f1"), F.avg(F.when(F.col("task") == "single_doc_qa", F.col("f1"))).alias("single"), (F.max("p95_latency_ms") / 25000.0).alias("ratio"), F.sum("oom_count").alias("oom"))
    passed = (F.avg("f1") >= 0.34) & (F.avg("single") >= 0.29) & (F.avg("ratio") <= 1.8) & (F.sum("oom") == 0)
    return per.agg(F.round(F.avg("f1"), 9).alias("mean_f1"), F.round(F.avg("single"), 9).alias("mean_single"), F.round(F.avg("ratio"), 9).alias("mean_ratio"), F.sum("oom").alias("oom_sum"), passed.alias("passed"))


@query(f"WITH {PREDS} SELECT phase, round(sum(ms), 3) AS ms, round(avg(ms), 6) AS mean_ms FROM (SELECT unnest(['total', 'llm', 'retrieval', 'overhead']) AS phase, unnest([latency_ms.total, latency_ms.llm, latency_ms.retrieval, latency_ms.overhead]) AS ms FROM preds) WHERE ms IS NOT NULL GROUP BY phase")
def phase_timing(spark, d):
    phases = F.array(*(F.struct(F.lit(p).alias("phase"), F.col(f"latency_ms.{p}").alias("ms")) for p in ("total", "llm", "retrieval", "overhead")))
    long = preds(spark, d).select(F.explode(phases).alias("p")).select("p.*").where(F.col("ms").isNotNull())
    return long.groupBy("phase").agg(F.round(F.sum("ms"), 3).alias("ms"), F.round(F.avg("ms"), 6).alias("mean_ms"))
