"""Evidence of a sample: formatting, facts, pruning to a token budget and best answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .skew import spread_rank

#: What is answered without evidence; a parameter of best_answers.
NOT_ENOUGH = "Not enough information to answer."


def positioned(hits: DataFrame) -> DataFrame:
    """Adds pos: each chunk's place within its sample, by chunk_id unless it has one."""
    if "pos" in hits.columns:
        return hits
    return spread_rank(hits, "sample_id", [F.col("chunk_id")], "pos").withColumn("pos", F.col("pos") - 1)


def formatted_evidence(hits: DataFrame, most: int | None = None) -> DataFrame:
    """``sample_id, evidence``: the chunks of each sample, labelled, one to a line.

    All of them in order of pos, or of chunk_id where there is none, or the first ``most``. A
    sample's lines are one row, so hits of a retrieval are better than a pool's whole chunks.
    """
    order = "pos" if "pos" in hits.columns else "chunk_id"
    line = F.concat(F.lit("["), F.coalesce("doc_id", F.lit("")), F.lit("#"), F.col("chunk_id"), F.lit("] "), T.safe_text(F.col("text")))
    if most is not None:
        # a filter on the row number itself lets each map task keep only its first rows of a hot sample
        hits = hits.withColumn("pos", F.row_number().over(Window.partitionBy("sample_id").orderBy(order))).where(F.col("pos") <= most)
        order = "pos"
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), line.alias("line"))))
    return hits.groupBy("sample_id").agg(listed.alias("l")).select("sample_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("evidence"))


def facts(hits: DataFrame, limit: int = 3, width: int = 80) -> DataFrame:
    """The first ``limit`` chunks with text as facts; an id keeps the chunk's place among all.

    Confidence is the chunk's score within 0 and 1, and 0.5 where it has none.
    """
    text = positioned(hits).withColumn("body", T.safe_text(F.col("text"))).where("body <> ''")
    ranked = text.withColumn("m", F.row_number().over(Window.partitionBy("sample_id").orderBy("pos"))).where(F.col("m") <= limit)
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.col("score"), F.lit(0.5))))
    return ranked.select("sample_id", F.concat("sample_id", F.lit("_f"), "pos").alias("fact_id"), F.lit("summary").alias("type"), F.substring("body", 1, width).alias("content"), "doc_id", "chunk_id", confidence.alias("confidence"))


def support(fact_rows: DataFrame) -> DataFrame:
    """``sample_id, chunk_id, support``: how many facts rest on each chunk."""
    return fact_rows.groupBy("sample_id", "chunk_id").agg(F.count("*").alias("support"))


def pruned(hits: DataFrame, budget: int, strategy: str = "support") -> DataFrame:
    """Adds dropped: chunks go in order until those left fit the budget of tokens.

    Needs sample_id, chunk_id, pos, tokens, support and score. 'support' drops the least
    supported, then lowest scored, then earliest; any other strategy the oldest.
    """
    order = [F.col("support"), F.col("score"), F.col("pos")] if strategy == "support" else [F.col("pos")]
    w = Window.partitionBy("sample_id")
    before = F.coalesce(F.sum("tokens").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return hits.withColumn("dropped", F.sum("tokens").over(w) - before > budget)


def best_chunks(hits: DataFrame) -> DataFrame:
    """Of each sample the first chunk that contains most question tokens, repeated ones counted again.

    Needs sample_id, question, chunk_id, pos and text; adds hits.
    """
    low = F.lower(F.coalesce("text", F.lit("")))
    n = F.size(F.filter(T.query_tokens(F.col("question")), lambda t: F.contains(low, t)))
    rated = hits.withColumn("hits", n)
    return rated.withColumn("_rn", F.row_number().over(Window.partitionBy("sample_id").orderBy(F.col("hits").desc(), "pos"))).where("_rn = 1").drop("_rn")


def best_answers(hits: DataFrame, kind: Column, most: int = 96) -> DataFrame:
    """``sample_id, kind, answer``: extracted by kind from the best chunk, else from the first that yields.

    Without any extract the best chunk's beginning; without chunks a sample has no row.
    """
    most = max(24, most)
    low = F.lower(F.coalesce("text", F.lit("")))
    n = F.size(F.filter(T.query_tokens(F.col("question")), lambda t: F.contains(low, t)))
    named = F.when(T.paragraph_number(F.col("text")) == "", "").when(F.coalesce("question", F.lit("")).rlike("[一-鿿]"), F.concat(F.lit("段落"), T.paragraph_number(F.col("text")))).otherwise(F.concat(F.lit("Paragraph "), T.paragraph_number(F.col("text"))))
    rated = hits.withColumns({"kind": kind, "n": n, "number": T.first_number(F.col("text")), "paragraph": named})
    first = lambda c: F.min(F.when(F.col(c) != "", F.struct("pos", c)))[c]
    best = F.max(F.struct("n", (-F.col("pos")).alias("at"), F.col("text"), "number", "paragraph"))
    per = rated.groupBy("sample_id").agg(F.first("kind").alias("kind"), best.alias("b"), first("number").alias("any_number"), first("paragraph").alias("any_paragraph"))
    text = T.safe_text(F.col("b.text"))
    cut = F.when(F.length(text) > most, F.regexp_replace(F.substring(text, 1, most), "[ ,:;：；]+$", "")).otherwise(text)
    found = (
        F.when(F.col("kind") == "count", F.coalesce(F.nullif(F.col("b.number"), F.lit("")), F.col("any_number")))
        .when(F.col("kind") == "paragraph_id", F.coalesce(F.nullif(F.col("b.paragraph"), F.lit("")), F.col("any_paragraph")))
        .when(F.col("kind") == "entity_short", T.short_entity(text, min(48, most)))
    )
    answer = T.strip(F.coalesce(F.nullif(found, F.lit("")), cut))
    return per.select("sample_id", "kind", F.when(answer == "", NOT_ENOUGH).otherwise(answer).alias("answer"))
