"""Checks of records: violations as a column, and gates that raise."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TASKS = ("single_doc_qa", "multi_doc_qa", "code_qa")


def _list(*checks: tuple[Column, str]) -> Column:
    return F.array_join(F.filter(F.array(*(F.when(F.coalesce(c, F.lit(True)), m) for c, m in checks)), lambda x: x.isNotNull()), ";")


def sample_violations(df: DataFrame) -> DataFrame:
    """Adds violations: what breaks the sample schema, in field order, joined by ';'."""
    blank = lambda c: F.length(F.coalesce(c, F.lit(""))) < 1
    docs = F.col("documents")
    return df.withColumn(
        "violations",
        _list(
            (blank(F.col("id")), "id"), (~F.coalesce(F.col("task").isin(*TASKS), F.lit(False)), "task"), (blank(F.col("question")), "question"), (F.coalesce(F.size(docs), F.lit(0)) < 1, "documents"),
            (F.coalesce(~F.forall(docs, lambda e: ~blank(e["doc_id"])), F.lit(False)), "documents.doc_id"), (F.coalesce(~F.forall(docs, lambda e: ~blank(e["text"])), F.lit(False)), "documents.text"), (F.col("answer").isNull(), "answer"),
        ),
    )


def result_violations(df: DataFrame) -> DataFrame:
    """Adds violations of the prediction schema."""
    less = lambda c, least: F.col(c).isNull() | (F.col(c) < least)
    modes = F.col("backend_mode").isNotNull() & ~F.col("backend_mode").isin("real", "mock", "unknown")
    return df.withColumn("violations", _list((F.col("id").isNull(), "id"), (F.col("pred").isNull(), "pred"), (F.col("gold").isNull(), "gold"), (less("n_steps", 1), "n_steps"), (less("n_retrieval", 0), "n_retrieval"), (F.col("latency_ms.total").isNull(), "latency_ms.total"), (F.coalesce(modes, F.lit(False)), "backend_mode")))


def require_valid(df: DataFrame, key: str = "id") -> DataFrame:
    """Fails a job at the first row with violations, naming it; else the rows without that column."""
    bad = F.col("violations") != ""
    checked = F.when(bad, F.raise_error(F.concat(F.lit("invalid record "), F.coalesce(F.col(key).cast("string"), F.lit("null")), F.lit(": "), F.col("violations")))).otherwise(F.lit(True))
    return df.where(checked.cast("boolean")).drop("violations")


def duplicate_ids(df: DataFrame, key: str = "id") -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def require_count(df: DataFrame, expected: int) -> None:
    found = df.count()
    if found != expected:
        raise ValueError(f"{found} rows instead of {expected}")


def require_disjoint(a: DataFrame, b: DataFrame, key: str = "id") -> None:
    shared = a.join(b.select(key).distinct(), key, "left_semi").limit(1).collect()
    if shared:
        raise ValueError(f"{key} {shared[0][key]} is on both sides")


def backend_failures(df: DataFrame, every_row: bool) -> DataFrame:
    """Rows whose backend isn't 'real'; unless every row must be, errors excuse it."""
    wrong = F.coalesce(F.col("backend_mode"), F.lit("unknown")) != "real"
    return df.where(wrong if every_row else wrong & (F.coalesce("error_count", F.lit(0)) <= 0))


def distill_quality(tag: Column, content: Column, least: int = 2, most: int = 24) -> tuple[Column, Column]:
    """Whether a parsed controller output is usable, and the reason."""
    n = F.length(F.coalesce(content, F.lit("")))
    ok_tag = F.coalesce(tag.isin("search", "final"), F.lit(False))
    reason = F.when(~ok_tag, "invalid_tag").when((tag == "search") & ((n < least) | (n > most)), "keyword_length").otherwise("ok")
    return reason == "ok", reason


def any_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
