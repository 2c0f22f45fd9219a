"""Whole evaluations: retrieval baseline, agent run, report and gate."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import agent, metrics, prompts, retrieve, sampling
from ..session import ship_package




def baseline(samples: DataFrame, chunks: DataFrame, k: int = 3, model: agent.Model | None = None, temperature: float = 0.2, max_tokens: int = 256, cut: int = 160, formal: bool = False) -> DataFrame:
    """One retrieval and one answer per sample: id, pred, n_steps, n_retrieval, error_count, backend_mode and totals of tokens and chunks.

    The prompt is the plain text of the k best chunks. A model that fails costs an error and
    the first hit's first ``cut`` code points answer; its backend is 'unknown', or a
    formal run fails. Without a model the best sentence answers, as an expression, and the
    backend is 'mock'.
    """
    ship_package(samples.sparkSession)
    queries = samples.select(F.col("id").alias("qid"), F.col("id").alias("sample_id"), "question")
    best = retrieve.lexical_top_k(queries, chunks, k).join(chunks.select("chunk_id", "text"), "chunk_id")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))
    hits = best.groupBy(F.col("qid").alias("id")).agg(F.transform(listed, lambda x: x["text"]).alias("hits"))
    joined = samples.select("id", "question").join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.array().cast("array<string>")))
    context = F.array_join(F.transform("hits", T.safe_text), "\n")
    asked = joined.select("id", "question", context.alias("context"), prompts.baseline_prompt(F.col("question"), context).alias("prompt"), F.size("hits").cast("long").alias("found"), F.coalesce(F.try_element_at("hits", F.lit(1)), F.lit("")).alias("first"))
    if model is None:
        answered = asked.select("*", T.best_sentence(F.col("question"), F.col("context")).alias("pred"), F.lit(0).alias("error_count"), F.lit("mock").alias("backend_mode"))
    else:
        answered = asked.mapInArrow(lambda batches: _answered(batches, model, temperature, max_tokens, cut, formal), "id string, question string, context string, prompt string, found long, first string, pred string, error_count int, backend_mode string")
    pred = T.safe_text(F.col("pred"))
    return answered.select(
        "id", pred.alias("pred"), F.lit(1).alias("n_steps"), (F.col("found") > 0).cast("int").alias("n_retrieval"), "error_count", "backend_mode",
        T.approx_tokens(F.col("prompt"), 1).alias("prompt_tokens_total"), T.approx_tokens(F.col("pred"), 1).alias("completion_tokens_total"), F.col("found").alias("retrieved_chunks_total"),
    )


def _answered(batches: Iterable[pa.RecordBatch], model: agent.Model, temperature: float, max_tokens: int, cut: int, formal: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = []
        for question, context, prompt, first in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3, 5))):
            try:
                said = model.generate(prompt, False, temperature, max_tokens) if hasattr(model, "generate") else model(question or "", context, 1, 1, False)
                tag, content = agent.parsed(said)
                made.append((content if tag else said, 0, getattr(model, "backend", "real")))
            except Exception:
                if formal:
                    raise
                made.append((first[:cut], 1, "unknown"))
        kinds = (pa.string(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([m[i] for m in made], t) for i, t in enumerate(kinds))], names=[*batch.schema.names, "pred", "error_count", "backend_mode"])


def agent_run(samples: DataFrame, chunks: DataFrame, done: DataFrame | None = None, model: agent.Model = agent.mock_model, limits: agent.Limits | None = None) -> DataFrame:
    """Results of the samples that have none yet."""
    rest = sampling.without(samples, done, "id") if done is not None else samples
    return agent.run(rest, chunks, model, limits)


def report(preds: DataFrame, gold: DataFrame, key_tasks: list[str]) -> dict[str, DataFrame]:
    """The tables of one evaluation: overall, by task, key tasks both ways, and error cases."""
    rows = metrics.scored_rows(preds, gold)
    per_task = metrics.summary(rows, "task")
    return {
        "overall": metrics.summary(rows),
        "tasks": per_task,
        "key_micro": metrics.summary(rows.where(F.col("task").isin(key_tasks))),
        "key_macro": metrics.macro(per_task.withColumn("all", F.lit(1)), key_tasks, "all").drop("all"),
        "errors": metrics.error_cases(rows),
    }
