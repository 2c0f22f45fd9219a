"""Schemas, rounds, students, streams and small filters, each with its SQL."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import memory, ops, retrieve, rounds, sampling, schema, stats, validate
from ..registry import query
from ..session import shared_folder, table
from ..sources import files
from ..streaming import progress
from .base import CHUNKS, PREDS, SAMPLES, chunks, preds, samples, sql_strip
from .evaluation import METHOD, ROWS, rows
from .retrieval import LEXICAL

_NO = lambda c, m: f"CASE WHEN {c} THEN '{m}' END"


@query(
    f"WITH {SAMPLES} SELECT id, concat_ws(';', {_NO('length(id) < 1', '.id: shorter than 1')}, {_NO('task IS NULL', '.task: missing')}, "
    + _NO("task NOT IN ('single_doc_qa', 'multi_doc_qa', 'code_qa')", ".task: not one of 3 values")
    + f", {_NO('question IS NULL', '.question: missing')}, {_NO('length(question) < 1', '.question: shorter than 1')}, {_NO('answer IS NULL', '.answer: missing')}, {_NO('documents IS NULL', '.documents: missing')}, {_NO('len(documents) < 1', '.documents: fewer than 1 items')}, "
    + ", ".join(_NO(f"len(list_filter(documents, lambda e: {c})) > 0", f".documents[]{m}") for c, m in (("e IS NULL", ": missing"), ("e IS NOT NULL AND e.doc_id IS NULL", ".doc_id: missing"), ("length(e.doc_id) < 1", ".doc_id: shorter than 1"), ("e IS NOT NULL AND e.text IS NULL", ".text: missing"), ("length(e.text) < 1", ".text: shorter than 1")))
    + ") AS violations FROM samples"
)
def sample_schema(spark, d):
    return schema.violations(samples(spark, d), schema.SCHEMAS["sample"]).select("id", "violations")


@query(
    f"WITH {PREDS} SELECT id, concat_ws(';', {_NO('pred IS NULL', '.pred: missing')}, {_NO('gold IS NULL', '.gold: missing')}, {_NO('n_steps IS NULL', '.n_steps: missing')}, {_NO('n_steps < 1', '.n_steps: below 1')}, {_NO('n_retrieval IS NULL', '.n_retrieval: missing')}, {_NO('n_retrieval < 0', '.n_retrieval: below 0')}, "
    f"{_NO('latency_ms IS NULL', '.latency_ms: missing')}, {_NO('latency_ms IS NOT NULL AND latency_ms.total IS NULL', '.latency_ms.total: missing')}, " + _NO("backend_mode NOT IN ('real', 'mock', 'unknown')", ".backend_mode: not one of 3 values") + ") AS violations FROM preds"
)
def result_schema(spark, d):
    return schema.violations(preds(spark, d), schema.SCHEMAS["result"]).select("id", "violations")


@query(
    f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY chunk_id) - 1 AS pos FROM chunks), k AS (SELECT * FROM r WHERE {sql_strip('text')} <> ''), o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS m FROM k) "
    f"SELECT sample_id || '_f' || pos AS fact_id, concat_ws(';', {_NO('doc_id IS NULL', '.evidence.doc_id: missing')}, {_NO('length(doc_id) < 1', '.evidence.doc_id: shorter than 1')}) AS violations FROM o WHERE m <= 3"
)
def fact_schema(spark, d):
    made = memory.facts(chunks(spark, d).withColumn("score", F.lit(0.5)))
    nested = made.select("fact_id", "type", "content", F.struct("doc_id", "chunk_id").alias("evidence"), "confidence")
    return schema.violations(nested, schema.SCHEMAS["fact"]).select("fact_id", "violations")


@query(f"WITH {SAMPLES} SELECT id FROM samples WHERE task = 'code_qa'")
def code_only(spark, d):
    return samples(spark, d).where("task = 'code_qa'").select("id")


@query(f"WITH {CHUNKS} SELECT chunk_id, coalesce(TRY_CAST(regexp_extract(chunk_id, '([^_]*)$', 1) AS DOUBLE), 0) AS last_part, coalesce(TRY_CAST(sample_id AS DOUBLE), 0) AS whole FROM chunks")
def safe_number(spark, d):
    return chunks(spark, d).select("chunk_id", files.number(F.regexp_extract("chunk_id", "([^_]*)$", 1)).alias("last_part"), files.number(F.col("sample_id")).alias("whole"))


@query(f"WITH {SAMPLES}, r AS (SELECT id, row_number() OVER (ORDER BY id) AS n FROM samples) SELECT id, CASE WHEN n <= 20 THEN 'dev' ELSE 'holdout' END AS part, 'v1' AS version FROM r WHERE n <= 50")
def annotated_samples(spark, d):
    return sampling.annotated(samples(spark, d).select("id"), {"dev": 20, "holdout": 30}, [F.col("id")], {"version": F.lit("v1")})


@query(f"WITH {SAMPLES}, {PREDS} SELECT (SELECT count(*) FROM samples) AS n, count(*) AS shared FROM samples JOIN preds USING (id)")
def counted_and_shared(spark, d):
    """The gates on counts and on disjoint ids, told as numbers; the gates themselves raise."""
    own, other = samples(spark, d).select("id"), preds(spark, d).select("id")
    validate.require_count(own, own.select("id").distinct().count())
    return own.agg(F.count("*").alias("n")).crossJoin(sampling.within(own, other, "id").agg(F.count("*").alias("shared")))  # one row each


_ROUNDS = (
    "r AS (SELECT o_orderpriority AS run, (year(o_orderdate) * 12 + month(o_orderdate))::BIGINT AS round, round(avg(o_totalprice) / 200000.0, 4) AS score, CASE WHEN count(*) % 3 = 0 THEN NULL ELSE count(*) % 2 = 0 END AS passed FROM orders GROUP BY ALL), "
    "n AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY round) AS i FROM r), "
    "f AS (SELECT run, i, round, score, score AS best, true AS improved, false AS rollback, 0 AS idle, CASE WHEN coalesce(passed, false) THEN 1 ELSE 0 END AS passes, NULL::BIGINT AS prior FROM n WHERE i = 1 UNION ALL "
    "SELECT n.run, n.i, n.round, n.score, CASE WHEN n.score - f.best >= 0.002 THEN n.score ELSE f.best END, n.score - f.best >= 0.002, NOT (n.score - f.best >= 0.002) AND n.score < f.best - 0.03, CASE WHEN n.score - f.best >= 0.002 THEN 0 ELSE f.idle + 1 END, "
    "CASE WHEN NOT (NOT (n.score - f.best >= 0.002) AND n.score < f.best - 0.03) AND coalesce(n.passed, false) THEN f.passes + 1 ELSE 0 END, f.round FROM f JOIN n ON n.run = f.run AND n.i = f.i + 1), "
    "c AS (SELECT *, CASE WHEN rollback THEN 'rollback' WHEN passes >= 2 THEN 'confirm' WHEN idle >= 2 THEN 'stop' WHEN passes > 0 THEN 'keep' ELSE 'edit' END AS decision FROM f)"
)


def _rounds(spark, d):
    orders = table(spark, d, "orders")
    n = F.count("*")
    made = orders.groupBy(F.col("o_orderpriority").alias("run"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("round")).agg(F.round(F.avg(F.col("o_totalprice").cast("double")) / 200000.0, 4).alias("score"), F.when(n % 3 != 0, n % 2 == 0).alias("passed"))
    return rounds.controlled(made, "run")


@query(f"WITH RECURSIVE {_ROUNDS} SELECT run, round, score, best AS best_score, improved, rollback, idle::INT AS idle, passes::INT AS passes, coalesce(prior, -1) AS prior, decision FROM c")
def round_control(spark, d):
    return _rounds(spark, d).withColumn("prior", F.coalesce("prior", F.lit(-1)))


@query(f"WITH RECURSIVE {_ROUNDS} SELECT run, string_agg('round ' || round || ': score ' || printf('%.4f', score) || ', best ' || printf('%.4f', best) || ', ' || decision, chr(10) ORDER BY round) AS report FROM c GROUP BY run")
def round_report(spark, d):
    return rounds.round_report(_rounds(spark, d), "run")


_SUMMARY = ("em", "f1", "avg_retrieval", "avg_latency_ms")


def _summary_sql(how: str) -> str:
    weight = "n_samples" if how == "micro" else "1"
    keyed = ", ".join(f"coalesce(sum({m} * {weight}) FILTER (scope IN ('multi_doc_qa', 'code_qa')) / sum({weight}) FILTER (scope IN ('multi_doc_qa', 'code_qa')), 0) AS {m}" for m in _SUMMARY)
    shown = ", ".join([f"round(b.{m}, 6) AS {m}" for m in _SUMMARY] + [f"round(b.{m} - t.{m}, 6) AS delta_{m.removeprefix('avg_')}" for m in _SUMMARY])
    return (
        f"WITH {ROWS}, per AS (SELECT {METHOD} AS model, task AS scope, count(*) AS n_samples, avg(coalesce(em, 0)) AS em, avg(coalesce(f1, 0)) AS f1, avg(coalesce(n_retrieval, 0)) AS avg_retrieval, avg(coalesce(latency_ms.total, 0)) AS avg_latency_ms FROM rows GROUP BY ALL), "
        f"k AS (SELECT model, 'key_{how}' AS scope, coalesce(sum(n_samples) FILTER (scope IN ('multi_doc_qa', 'code_qa')), 0)::BIGINT AS n_samples, {keyed} FROM per GROUP BY model), b AS (SELECT * FROM per UNION ALL BY NAME SELECT * FROM k) "
        f"SELECT b.scope, b.model, b.n_samples, {shown} FROM b LEFT JOIN b t ON t.scope = b.scope AND t.model = 'baseline'"
    )


def _models(spark, d):
    return rows(spark, d).withColumn("model", F.expr(METHOD))


@query(_summary_sql("macro"))
def student_summary_macro(spark, d):
    return stats.student_summary(_models(spark, d), ["multi_doc_qa", "code_qa"], "baseline")


@query(_summary_sql("micro"))
def student_summary_micro(spark, d):
    return stats.student_summary(_models(spark, d), ["multi_doc_qa", "code_qa"], "baseline", "micro")


@query(
    f"WITH {SAMPLES}, {CHUNKS}, queries AS (SELECT id AS qid, id AS sample_id, question, answer FROM samples WHERE task = 'multi_doc_qa'), {LEXICAL}, "
    "allp AS (SELECT q.qid, q.answer, c.chunk_id, c.text, coalesce(lex.score, 0.0) AS score FROM queries q LEFT JOIN chunks c USING (sample_id) LEFT JOIN lex ON lex.qid = q.qid AND lex.chunk_id = c.chunk_id), "
    "best AS (SELECT * FROM allp QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) = 1) "
    "SELECT count(*) AS n_searches, round(coalesce(avg((coalesce(answer, '') <> '' AND contains(coalesce(text, ''), coalesce(answer, '')))::INT), 0), 6) AS hit_rate FROM best"
)
def keyword_hit_rate(spark, d):
    asked = samples(spark, d).where("task = 'multi_doc_qa'").select(F.col("id").alias("qid"), F.col("id").alias("sample_id"), "question", F.col("answer").alias("gold"))
    found = retrieve.lexical_top_k(asked, chunks(spark, d), 1).join(chunks(spark, d).select("chunk_id", "text"), "chunk_id")
    return stats.keyword_hits(asked, found)


@query("SELECT event_type AS method, strftime(date_trunc('hour', ts), '%Y-%m-%d %H:00') AS start, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def stream_throughput(spark, d):
    """The events table read as a stream, to its end; every window with all its rows."""
    source = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet" if os.path.isfile(f"{d}/events.parquet") else "*.parquet")
    stream = source.parquet(d if os.path.isfile(f"{d}/events.parquet") else f"{d}/events.parquet")
    name = f"throughput_{uuid.uuid4().hex}"
    made = progress.throughput(stream.withColumn("ts", F.col("ts").cast("timestamp")))
    made.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", f"{shared_folder(spark)}/{name}").trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("method", F.date_format("start", "yyyy-MM-dd HH:00").alias("start"), "n", F.round("mean", 6).alias("mean"))


_STEPS = "SELECT * FROM (VALUES ('start', 0, 1), ('exit', 1, 2), ('start', 1, 3), ('exit', 2, 4), ('start', 2, 5), ('exit', 3, 6)) t(event, share, moment)"


@query(
    f"WITH s AS ({_STEPS}), e AS (SELECT c_mktsegment AS method, c_custkey::BIGINT AS shard, moment::BIGINT AS moment, event, 170::BIGINT AS expected, CASE WHEN share = 3 AND c_custkey % 2 = 0 THEN 170 WHEN share = 1 AND c_custkey % 5 = 0 THEN 170 ELSE share * (c_custkey % 7) END::BIGINT AS out_lines FROM customer, s), "
    "t AS (SELECT *, count_if(event = 'start') OVER (PARTITION BY method, shard ORDER BY moment ROWS UNBOUNDED PRECEDING) AS tries FROM e), "
    "n AS (SELECT *, CASE WHEN out_lines = expected THEN 'completed' WHEN event = 'start' THEN CASE WHEN out_lines > 0 AND tries = 1 THEN 'retry_pending' ELSE 'running' END WHEN tries <= 2 THEN 'retry_pending' ELSE 'failed' END AS status FROM t), "
    "w AS (SELECT *, coalesce(lag(status) OVER (PARTITION BY method, shard ORDER BY moment), 'pending') AS was FROM n) SELECT method, shard, moment, was, status FROM w WHERE was <> status"
)
def shard_transitions(spark, d):
    steps = spark.createDataFrame([("start", 0, 1), ("exit", 1, 2), ("start", 1, 3), ("exit", 2, 4), ("start", 2, 5), ("exit", 3, 6)], "event string, share long, at long")
    key = F.col("c_custkey")
    lines = F.when((F.col("share") == 3) & (key % 2 == 0), 170).when((F.col("share") == 1) & (key % 5 == 0), 170).otherwise(F.col("share") * (key % 7))
    events = table(spark, d, "customer").crossJoin(F.broadcast(steps)).select(F.col("c_mktsegment").alias("method"), key.cast("long").alias("shard"), "at", "event", F.lit(170).cast("long").alias("expected"), lines.cast("long").alias("out_lines"))  # six rows
    return ops.transitions(events).withColumnRenamed("at", "moment")


@query(f"WITH {SAMPLES}, t AS (SELECT id, {sql_strip('question')} AS note FROM samples) SELECT id, CASE WHEN contains(lower(note), 'how many') THEN 'note: how many' ELSE 'note: who' END AS reason FROM t WHERE contains(lower(note), 'how many') OR contains(lower(note), 'who')")
def note_anomalies(spark, d):
    status = samples(spark, d).select("id", T.safe_text(F.col("question")).alias("note"), F.lit("running").alias("status"), F.lit(1).alias("attempts"))
    return ops.anomalies(status, ["how many", "who"]).select("id", "reason")


