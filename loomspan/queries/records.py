"""Validation, de-duplication, sampling, splits, controller rows and run operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..operators import distill, ops, sampling, stats, validate
from ..registry import query
from ..session import table
from .base import CHUNKS, PREDS, SAMPLES, chunks, preds, samples, sql_query_tokens, sql_strip
from .text import STOP

_SPLIT = "regexp_extract(id, '_(train|valid|test)_[0-9]+$', 1)"
_STUDENT = "student AS (SELECT DISTINCT * FROM student_train)"


def _split():
    return F.regexp_extract("id", "_(train|valid|test)_[0-9]+$", 1)


def _student(spark, d):
    return table(spark, d, "student_train").distinct()


@query(
    f"WITH {SAMPLES} SELECT id, concat_ws(';', CASE WHEN length(coalesce(id, '')) < 1 THEN 'id' END, CASE WHEN task IS NULL OR task NOT IN ('single_doc_qa', 'multi_doc_qa', 'code_qa') THEN 'task' END, CASE WHEN length(coalesce(question, '')) < 1 THEN 'question' END, CASE WHEN coalesce(len(documents), 0) < 1 THEN 'documents' END, "
    "CASE WHEN len(list_filter(documents, lambda e: length(coalesce(e.doc_id, '')) < 1)) > 0 THEN 'documents.doc_id' END, CASE WHEN len(list_filter(documents, lambda e: length(coalesce(e.text, '')) < 1)) > 0 THEN 'documents.text' END, CASE WHEN answer IS NULL THEN 'answer' END) AS violations FROM samples"
)
def schema_violations(spark, d):
    return validate.sample_violations(samples(spark, d)).select("id", "violations")


@query(
    f"WITH {PREDS} SELECT id, concat_ws(';', CASE WHEN pred IS NULL THEN 'pred' END, CASE WHEN gold IS NULL THEN 'gold' END, CASE WHEN n_steps IS NULL OR n_steps < 1 THEN 'n_steps' END, CASE WHEN n_retrieval IS NULL OR n_retrieval < 0 THEN 'n_retrieval' END, CASE WHEN latency_ms.total IS NULL THEN 'latency_ms.total' END, CASE WHEN backend_mode NOT IN ('real', 'mock', 'unknown') THEN 'backend_mode' END) AS violations FROM preds"
)
def result_violations(spark, d):
    return validate.result_violations(preds(spark, d)).select("id", "violations")


@query("SELECT id, count(*) AS n FROM baseline_rag GROUP BY id HAVING count(*) > 1")
def duplicate_ids(spark, d):
    return validate.duplicate_ids(table(spark, d, "baseline_rag"))


@query(f"WITH {PREDS} SELECT id, backend_mode, coalesce(error_count, 0) <= 0 AS run_gate FROM preds WHERE coalesce(backend_mode, 'unknown') <> 'real'")
def backend_gates(spark, d):
    own = validate.backend_failures(preds(spark, d), True)
    return own.select("id", "backend_mode", (F.coalesce("error_count", F.lit(0)) <= 0).alias("run_gate"))


@query(f"WITH {SAMPLES} SELECT id, task, epoch_us(prepared_at) AS prepared_us FROM samples")
def dedup_first_wins(spark, d):
    return samples(spark, d).select("id", "task", F.unix_micros("prepared_at").alias("prepared_us"))


@query(f"WITH {SAMPLES} SELECT id FROM samples WHERE {_SPLIT} = 'train' AND id NOT IN (SELECT id FROM baseline_rag)")
def anti_canonical(spark, d):
    return sampling.without(samples(spark, d).where(_split() == "train"), table(spark, d, "baseline_rag"), "id").select("id")


@query(f"WITH {SAMPLES} SELECT id, id IN (SELECT id FROM baseline_rag) AS done FROM samples")
def resume_remaining(spark, d):
    own, seen = samples(spark, d).select("id"), table(spark, d, "baseline_rag")
    done = sampling.within(own, seen, "id").withColumn("done", F.lit(True))
    return done.unionByName(sampling.without(own, seen, "id").withColumn("done", F.lit(False)))


@query(f"WITH {SAMPLES}, a AS (SELECT id, 'sample' AS origin FROM samples), b AS (SELECT DISTINCT id, 'student' AS origin FROM student_train) SELECT * FROM a UNION ALL SELECT * FROM b WHERE id NOT IN (SELECT id FROM a)")
def union_distinct(spark, d):
    return sampling.union_first("id", samples(spark, d).select("id", F.lit("sample").alias("origin")), table(spark, d, "student_train").select("id", F.lit("student").alias("origin")).distinct())


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM doc_labels WHERE doc_id IS NOT NULL)")
def set_difference(spark, d):
    return sampling.without(table(spark, d, "documents").select("doc_id"), table(spark, d, "doc_labels").where("doc_id is not null"), "doc_id")


_BINS = "l AS (SELECT doc_id, lang, source, length(coalesce(text, '')) AS n FROM documents), r AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS t FROM l), q AS (SELECT max(n) FILTER (i = floor((t - 1) * 0.25)) AS q1, max(n) FILTER (i = floor((t - 1) * 0.5)) AS q2, max(n) FILTER (i = floor((t - 1) * 0.75)) AS q3 FROM r), b AS (SELECT doc_id, coalesce(lang, 'und') AS lang, n, CASE WHEN n <= q1 THEN 0 WHEN n <= q2 THEN 1 WHEN n <= q3 THEN 2 ELSE 3 END AS bin FROM l, q)"
_STRATA = f"{_BINS}, s AS (SELECT lang || ':' || bin AS key, count(*) AS cap FROM b GROUP BY 1), x AS (SELECT key, cap, cap / sum(cap) OVER ()::DOUBLE * 100.0::DOUBLE AS exact, sum(cap) OVER () AS total FROM s), y AS (SELECT *, floor(exact) AS base, exact - floor(exact) AS part FROM x), z AS (SELECT *, row_number() OVER (ORDER BY part DESC, key) AS rank, 100 - sum(base) OVER () AS room FROM y), quota AS (SELECT key, cap, CASE WHEN total <= 100 THEN cap ELSE least(cap, base + CASE WHEN rank <= room THEN 1 ELSE 0 END) END::BIGINT AS quota FROM z)"


def _binned(spark, d):
    own = table(spark, d, "documents").select("doc_id", F.coalesce("lang", F.lit("und")).alias("lang"), F.length(F.coalesce("text", F.lit(""))).alias("n"))
    return sampling.length_bins(own, "n")


@query(f"WITH {_BINS} SELECT doc_id, bin FROM b")
def length_bins(spark, d):
    return _binned(spark, d).select("doc_id", "bin")


def _key():
    return F.concat("lang", F.lit(":"), "bin")


@query(f"WITH {_STRATA} SELECT key, cap, quota FROM quota")
def largest_remainder(spark, d):
    return sampling.quotas(_binned(spark, d).groupBy(_key().alias("key")).agg(F.count("*").alias("cap")), 100)


@query(f"WITH {_STRATA}, o AS (SELECT doc_id, lang || ':' || bin AS key, md5(doc_id || ':42') AS ord FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ord, doc_id) AS rn FROM o), m AS (SELECT doc_id, ord, rn <= quota AS inside FROM n JOIN quota USING (key)) SELECT doc_id FROM m ORDER BY inside DESC, ord, doc_id LIMIT 100")
def stratified_sample(spark, d):
    return sampling.stratified(_binned(spark, d), _key(), "doc_id", 100).select("doc_id")


@query(f"WITH {SAMPLES}, k AS (SELECT id, coalesce(task, 'unknown') AS task FROM samples), w AS (SELECT *, count(*) OVER (PARTITION BY task) AS n, row_number() OVER (PARTITION BY task ORDER BY md5(id || ':42'), id) AS rn FROM k) SELECT id, CASE WHEN n > 1 AND rn <= greatest(1, least(round_even(n * 0.1::DOUBLE, 0), n - 1)) THEN 'valid' ELSE 'train' END AS split FROM w")
def train_valid_split(spark, d):
    return sampling.two_way(samples(spark, d).select("id", F.coalesce("task", F.lit("unknown")).alias("task")), "task", "id", 0.1).select("id", "split")


@query(
    f"WITH {SAMPLES}, k AS (SELECT id, coalesce(meta['dataset'], 'unknown') AS g FROM samples), w AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, row_number() OVER (PARTITION BY g ORDER BY md5(id || ':42'), id) AS rn FROM k), a AS (SELECT *, CASE WHEN n = 1 THEN 0 WHEN n = 2 THEN 1 ELSE greatest(1, least(round_even(n * 0.8::DOUBLE, 0), n - 2)) END AS a FROM w), "
    "b AS (SELECT *, CASE WHEN n <= 2 THEN 0 ELSE greatest(1, least(round_even(n * 0.1::DOUBLE, 0), n - a - 1)) END AS b FROM a) SELECT id, CASE WHEN rn <= a THEN 'train' WHEN rn <= a + b THEN 'valid' ELSE 'test' END AS split FROM b"
)
def three_way_split(spark, d):
    own = samples(spark, d).select("id", F.coalesce(F.col("meta")["dataset"], F.lit("unknown")).alias("g"))
    return sampling.three_way(own, "g", "id").select("id", "split")


@query(f"WITH {SAMPLES} SELECT id FROM samples ORDER BY id LIMIT 20 OFFSET 10")
def slice_rows(spark, d):
    return sampling.slice_rows(samples(spark, d).select("id"), [F.col("id")], 10, 30)


@query("WITH b AS (SELECT subject, row_number() OVER (ORDER BY subject) - 1 AS rn, count(*) OVER () AS n FROM subjects) SELECT subject || '_train_' || i AS subject FROM range(0, 37) t(i) JOIN b ON i % n = rn")
def replicate_rows(spark, d):
    return sampling.replicated(table(spark, d, "subjects").select("subject"), "subject", [F.col("subject")], 37, "train")


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 5")
def per_source_limit(spark, d):
    return sampling.per_source_limit(table(spark, d, "documents").select("doc_id", "source"), "source", [F.col("doc_id")], 5)


@query(f"WITH {SAMPLES} SELECT coalesce(task, 'unknown') AS task, {_SPLIT} AS split, count(*) AS n FROM samples GROUP BY ALL")
def task_counts(spark, d):
    return samples(spark, d).groupBy(F.coalesce("task", F.lit("unknown")).alias("task"), _split().alias("split")).agg(F.count("*").alias("n"))


_PARSED = (
    f"t AS (SELECT *, {sql_strip('output')} AS t FROM student), f AS (SELECT *, regexp_matches(t, '(?is)^<final>.*</final>$') AS a, regexp_matches(t, '(?is)^<search>.*</search>$') AS b FROM t), "
    f"p AS (SELECT *, CASE WHEN a <> b THEN CASE WHEN a THEN 'final' ELSE 'search' END END AS tag, CASE WHEN a <> b THEN {sql_strip('''regexp_extract(t, '(?is)^<[a-z]+>(.*?)</[a-z]+>$', 1)''')} END AS content FROM f), "
    "c AS (SELECT *, CASE WHEN tag IS NULL THEN 'invalid_tag' WHEN tag = 'search' AND (length(content) < 2 OR length(content) > 24) THEN 'keyword_length' ELSE 'ok' END AS reason FROM p)"
)


@query(f"WITH {_STUDENT}, {_PARSED} SELECT id, reason FROM c")
def distill_quality(spark, d):
    return distill.checked(_student(spark, d)).select("id", "reason")


@query(f"WITH {_STUDENT}, {_PARSED} SELECT count(*) AS total, count_if(reason = 'ok')::BIGINT AS kept, round(avg((reason <> 'ok')::INT), 6) AS invalid_rate, round(avg(coalesce(meta.repaired, false)::INT), 6) AS repaired_rate, round(avg((tag = 'search')::INT) FILTER (reason = 'ok'), 6) AS search_ratio, round(avg((tag = 'final')::INT) FILTER (reason = 'ok'), 6) AS final_ratio FROM c")
def distill_stats(spark, d):
    return distill.rates(_student(spark, d))


_TAUGHT = (
    f"{SAMPLES}, e AS (SELECT id, task, coalesce(question, '') AS question, coalesce(array_to_string(list_transform(documents, lambda e: coalesce(e.text, '')), chr(10)), '') AS evidence, list_filter({sql_query_tokens('question')}, lambda x: x NOT IN ({STOP})) AS keys FROM samples), "
    "t AS (SELECT *, length(evidence) < 24 OR len(list_filter(keys, lambda t: contains(lower(evidence), t))) < 2 AS thin FROM e), "
    "p AS (SELECT id, keys, unnest(regexp_split_to_array(evidence, '[\\n。！？!?]')) AS raw, unnest(range(1, len(regexp_split_to_array(evidence, '[\\n。！？!?]')) + 1)) AS i FROM t), "
    f"x AS (SELECT id, keys, i, {sql_strip('raw')} AS s FROM p), b AS (SELECT id, arg_min(s, (-len(list_filter(keys, lambda t: contains(lower(s), t)))) * 1000000 + i) AS best FROM x WHERE s <> '' GROUP BY id), "
    "f AS (SELECT t.*, CASE WHEN thin THEN coalesce(nullif(array_to_string(keys[1:4], ' '), ''), '关键信息') ELSE coalesce(best, '') END AS content FROM t LEFT JOIN b USING (id)), "
    "g AS (SELECT *, thin AND (length(content) < 2 OR length(content) > 24) AS bad FROM f), "
    "o AS (SELECT id, task, question, bad, CASE WHEN bad THEN '<final><search>' || content || '</search></final>' WHEN thin THEN '<search>' || content || '</search>' ELSE '<final>' || content || '</final>' END AS output, CASE WHEN thin AND NOT bad THEN 'search' ELSE 'final' END AS tag FROM g)"
)


@query(f"WITH {_TAUGHT} SELECT id, task, question, output, bad AS repaired, 'ok' AS quality_reason FROM o")
def distill_taught(spark, d):
    return distill.train_rows(distill.taught(samples(spark, d))).select("id", "task", "question", "output", "meta.repaired", "meta.quality_reason")


@query(
    f"WITH {_TAUGHT}, n AS (SELECT coalesce(task, 'unknown') AS task, count(*) AS n FROM o GROUP BY 1) SELECT count(*) AS total, count(*) AS valid, round(avg(bad::INT), 6) AS invalid_rate, round(avg(bad::INT), 6) AS repaired_rate, 0.0::DOUBLE AS dropped_rate, "
    "round(avg((tag = 'search')::INT), 6) AS search_ratio, round(avg((tag = 'final')::INT), 6) AS final_ratio, (SELECT string_agg(task || '=' || n, ',' ORDER BY task) FROM n) AS tasks FROM o"
)
def distill_taught_stats(spark, d):
    told = distill.taught_rates(distill.taught(samples(spark, d)))
    entries = F.transform(F.array_sort(F.map_entries("task_distribution")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return told.withColumn("tasks", F.array_join(entries, ",")).drop("task_distribution")


@query(f"WITH {_STUDENT}, {_PARSED} SELECT task, count(*) AS n, round(avg((tag = 'search')::INT), 6) AS search_ratio, CASE WHEN avg((tag = 'search')::INT) >= 0.5 THEN 'search' ELSE 'final' END AS action, round_even(coalesce(avg(length(content)) FILTER (tag = 'search'), 0), 0)::BIGINT AS keyword_length FROM c WHERE reason = 'ok' GROUP BY task")
def policy_fit(spark, d):
    return distill.policy(_student(spark, d))


@query(f"WITH {_STUDENT} SELECT id, array_to_string(list_concat(list_transform(messages, lambda m: '[' || m.role || ']' || chr(10) || m.content), ['[output]' || chr(10) || coalesce(output, '')]), chr(10) || chr(10)) AS body FROM student")
def training_text(spark, d):
    return _student(spark, d).select("id", distill.training_text(F.col("messages"), F.col("output")).alias("body"))


@query(f"WITH {SAMPLES}, t AS (SELECT id, list_transform(documents[1:2], lambda e: [coalesce(e.doc_id, ''), {sql_strip('e.text')}]) AS l FROM samples) SELECT id, coalesce(array_to_string(list_transform(l, lambda x: '[' || x[1] || '] ' || CASE WHEN length(x[2]) > 180 THEN substring(x[2], 1, 180) || '...' ELSE x[2] END), chr(10)), '') AS summary FROM t")
def evidence_summary(spark, d):
    return samples(spark, d).select("id", F.coalesce(distill.evidence_summary(F.col("documents")), F.lit("")).alias("summary"))


@query(f"WITH {PREDS}, {SAMPLES} SELECT p.id, CASE WHEN p.n_steps < 3 AND (coalesce(s.task IN ('multi_doc_qa'), false) OR p.n_retrieval < 2) THEN 'search' ELSE 'final' END AS action FROM preds p LEFT JOIN samples s USING (id)")
def student_rule(spark, d):
    own = preds(spark, d).join(samples(spark, d).select("id", "task"), "id", "left")
    return own.select("id", distill.rule_action(F.coalesce("task", F.lit("")), F.col("n_retrieval"), F.col("n_steps"), F.lit(3)).alias("action"))


_TOTALS = "totals AS (SELECT event_type AS method, count(*) AS total FROM events GROUP BY 1)"
_PLAN = f"{_TOTALS}, plan AS (SELECT method, a // 170 AS shard, a AS start, least(a + 170, total) AS \"end\", least(a + 170, total) - a AS expected FROM (SELECT method, total, unnest(range(0, total, 170)) AS a FROM totals))"
_DONE = "done AS (SELECT event_type AS method, (rn - 1) // 170 AS shard, count_if(value > 5)::BIGINT AS out_lines, max(user_id % 4)::BIGINT AS attempts FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events) GROUP BY ALL)"
_STATUS = f"{_PLAN}, {_DONE}, st AS (SELECT p.*, coalesce(out_lines, 0) AS out_lines, coalesce(attempts, 0) AS attempts, CASE WHEN coalesce(out_lines, 0) = expected THEN 'completed' WHEN coalesce(attempts, 0) > 2 THEN 'failed' WHEN coalesce(out_lines, 0) > 0 OR coalesce(attempts, 0) > 0 THEN 'retry_pending' ELSE 'pending' END AS status FROM plan p LEFT JOIN done USING (method, shard))"


def _plan(spark, d):
    return ops.shard_plan(table(spark, d, "events").groupBy(F.col("event_type").alias("method")).agg(F.count("*").alias("total")))


def _status(spark, d):
    ranked = sampling.ranks(table(spark, d, "events"), "event_type", "event_id")
    done = ranked.groupBy(F.col("event_type").alias("method"), F.floor((F.col("rank") - 1) / 170).alias("shard")).agg(F.count_if(F.col("value") > 5).alias("out_lines"), F.max(F.col("user_id") % 4).alias("attempts"))
    return ops.shard_status(_plan(spark, d), done)


@query(f'WITH {_PLAN} SELECT method, shard, start, "end", expected FROM plan')
def shard_plan(spark, d):
    return _plan(spark, d)


@query(f"WITH {_STATUS} SELECT method, shard, out_lines, attempts, status FROM st")
def shard_status(spark, d):
    return _status(spark, d).select("method", "shard", "out_lines", "attempts", "status")


@query(f"WITH {_STATUS} SELECT method, count(*) AS shards, count_if(status = 'completed')::BIGINT AS completed, count_if(status = 'failed')::BIGINT AS failed, sum(out_lines)::BIGINT AS lines, round(sum(out_lines) / sum(expected), 6) AS share, count_if(status <> 'completed') = 0 AS mergeable FROM st GROUP BY method")
def shard_progress(spark, d):
    return ops.progress(_status(spark, d))


@query(f"WITH {_STATUS} SELECT method, shard, row_number() OVER (PARTITION BY method ORDER BY CASE WHEN status = 'retry_pending' THEN 0 ELSE 1 END, start)::INT AS place FROM st WHERE status IN ('retry_pending', 'pending')")
def pending_order(spark, d):
    return ops.pending_order(_status(spark, d)).select("method", "shard", "place")


@query(f"WITH {_STATUS} SELECT method, shard, CASE WHEN status = 'failed' THEN 'failed' WHEN status = 'retry_pending' THEN 'retry' ELSE 'late' END AS reason FROM st WHERE status IN ('failed', 'retry_pending') OR (status = 'completed' AND attempts > 1)")
def shard_anomalies(spark, d):
    return ops.anomalies(_status(spark, d)).select("method", "shard", "reason")


@query(f"WITH {_STATUS}, c AS (SELECT method, count_if(status = 'completed') AS done, count_if(status = 'retry_pending') AS running, count_if(status = 'failed') AS failed, count_if(status <> 'completed') = 0 AS merged FROM st GROUP BY method) SELECT method, CASE WHEN merged THEN 'finished' WHEN failed > 0 THEN 'blocked' WHEN running > 0 THEN 'running' WHEN done > 0 THEN 'waiting_merge' ELSE 'not_started' END AS stage FROM c")
def stage_class(spark, d):
    n = lambda s: F.count_if(F.col("status") == s)
    counts = _status(spark, d).groupBy("method").agg(n("completed").alias("done"), n("retry_pending").alias("running"), n("failed").alias("failed"), (F.count_if(F.col("status") != "completed") == 0).alias("merged"))
    return counts.select("method", ops.stage(F.col("done"), F.col("running"), F.col("failed"), F.col("merged")).alias("stage"))


@query(f"WITH {_STATUS} SELECT method, string_agg(method || '[' || shard || '] ' || start || '-' || \"end\" || ' ' || status || ' ' || out_lines || '/' || expected, chr(10) ORDER BY shard) AS report FROM st GROUP BY method")
def status_report(spark, d):
    return ops.report_lines(_status(spark, d))


@query("WITH n AS (SELECT max(ts) AS now FROM events), l AS (SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id) SELECT user_id, date_sub('second', last_ts, now) AS idle_s, date_sub('second', last_ts, now) >= 1800 AS stalled FROM l, n")
def stall_detect(spark, d):
    events = table(spark, d, "events")
    now = events.agg(F.max("ts").alias("now"))
    lasts = events.groupBy("user_id").agg(F.max("ts").alias("ts")).join(F.broadcast(now), F.lit(True))  # one row
    return ops.stalls(lasts.select("user_id", "ts", "now"), F.col("now"), 1800, "user_id", "now").select("user_id", "idle_s", "stalled")


@query("WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS prev, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) SELECT user_id, event_id, event_type FROM p WHERE n = 1 OR event_type IS DISTINCT FROM prev")
def snapshot_changes(spark, d):
    return stats.snapshot_changes(table(spark, d, "events").select("user_id", "event_id", "event_type"), ["event_id"], "event_type", "user_id")


@query("WITH f AS (SELECT user_id, event_id, coalesce(value > 10, false) AS ok FROM events), i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS g FROM f) SELECT user_id, event_id, sum(CASE WHEN ok THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, g ORDER BY event_id ROWS UNBOUNDED PRECEDING)::BIGINT AS streak FROM i")
def streaks(spark, d):
    own = table(spark, d, "events").select("user_id", "event_id", (F.col("value") > 10).alias("ok"))
    return stats.streaks(own, ["event_id"], "ok", "user_id").select("user_id", "event_id", "streak")


@query("WITH o AS (SELECT event_type || '.' || user_id % 5 AS key, CAST(count(*) AS VARCHAR) AS value FROM events WHERE event_id % 2 = 0 GROUP BY 1), n AS (SELECT event_type || '.' || user_id % 5 AS key, CAST(count(*) AS VARCHAR) AS value FROM events WHERE event_id % 2 = 1 GROUP BY 1) SELECT coalesce(o.key, n.key) AS key, o.value AS old, n.value AS new FROM o FULL JOIN n ON o.key = n.key WHERE o.value IS DISTINCT FROM n.value")
def config_diff(spark, d):
    side = lambda r: table(spark, d, "events").where(F.col("event_id") % 2 == r).groupBy(F.concat("event_type", F.lit("."), F.col("user_id") % 5).alias("key")).agg(F.count("*").cast("string").alias("value"))
    return stats.changed(side(0), side(1))


_VARIANTS = ["click", "pur"]


@query("SELECT event_type AS variant, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE contains(event_type, 'click') OR contains(event_type, 'pur') GROUP BY 1")
def variant_filter(spark, d):
    named = validate.any_of(*(F.contains("event_type", F.lit(v)) for v in _VARIANTS))
    return table(spark, d, "events").where(named).groupBy(F.col("event_type").alias("variant")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))


@query("SELECT arg_min(event_id, event_id) AS event_id, min(event_id) FILTER (contains(event_type, 'o')) AS by_part FROM events WHERE starts_with(event_type, 'c') OR contains(event_type, 'o')")
def first_by_prefix(spark, d):
    events = table(spark, d, "events").where(F.startswith("event_type", F.lit("c")) | F.contains("event_type", F.lit("o")))
    return events.agg(F.min("event_id").alias("event_id"), F.min(F.when(F.contains("event_type", F.lit("o")), F.col("event_id"))).alias("by_part"))


@query(f"WITH {CHUNKS} SELECT chunk_id, coalesce(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda s: {sql_strip('s')}), lambda s: s <> '')[-1], '') AS last_line, CASE WHEN starts_with(coalesce(text, ''), '/think') THEN text ELSE '/think ' || coalesce(text, '') END AS switched FROM chunks")
def reasoning_fallback(spark, d):
    return chunks(spark, d).select("chunk_id", names.last_line(F.col("text")).alias("last_line"), names.switched(F.col("text"), "/think").alias("switched"))


@query(f"WITH {PREDS}, p AS (SELECT id, 'results/seed_' || n_steps || '/' || coalesce(backend_mode, 'none') || '.jsonl' AS path FROM preds) SELECT id, regexp_extract(path, '([^/]+)\\.[^./]+$', 1) AS method, coalesce(nullif(regexp_extract(path, '.*(seed_[^/]*)', 1), ''), regexp_extract(path, '([^/]+)/[^/]+$', 1)) AS run_tag FROM p")
def run_tags(spark, d):
    path = F.concat(F.lit("results/seed_"), "n_steps", F.lit("/"), F.coalesce("backend_mode", F.lit("none")), F.lit(".jsonl"))
    own = preds(spark, d).withColumn("path", path)
    return own.select("id", names.method_of(F.col("path")).alias("method"), names.run_tag(F.col("path")).alias("run_tag"))


@query("WITH r AS (SELECT *, row_number() OVER (ORDER BY key) AS n, count(*) OVER () AS total FROM (SELECT DISTINCT c_mktsegment || '.' || c_nationkey AS key FROM customer)) SELECT CASE WHEN n = 13 THEN '... and ' || (total - 12) || ' more' ELSE key END AS line FROM r WHERE n <= 13")
def limited_diff(spark, d):
    keys = table(spark, d, "customer").select(F.concat("c_mktsegment", F.lit("."), "c_nationkey").alias("key")).distinct()
    return ops.limited(keys, "key", 12)
