"""Training rows for a small controller: checks, rates, its fitted policy and its texts."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship_package
from . import validate
from .models import Controller as Model
from .models import mock_model

#: The answer of a kept row whose output has no tag; as in the reference.
NO_ANSWER = "信息不足"


def checked(rows: DataFrame) -> DataFrame:
    """Adds tag, content, ok and reason of each output."""
    tag, content = T.strict_tag(F.col("output"))
    df = rows.withColumns({"tag": tag, "content": content})
    ok, reason = validate.distill_quality(F.col("tag"), F.col("content"))
    return df.withColumns({"ok": ok, "reason": reason})


def rates(rows: DataFrame) -> DataFrame:
    """One row: shares of invalid and repaired rows of all, and of search and final among usable ones."""
    df = checked(rows)
    share = lambda c: F.round(F.coalesce(F.avg(c.cast("double")), F.lit(0.0)), 6)
    return df.agg(
        F.count("*").alias("total"), F.count_if("ok").alias("kept"), share(~F.col("ok")).alias("invalid_rate"), share(F.coalesce(F.col("meta.repaired"), F.lit(False))).alias("repaired_rate"),
        share(F.when(F.col("ok"), F.col("tag") == "search")).alias("search_ratio"), share(F.when(F.col("ok"), F.col("tag") == "final")).alias("final_ratio"),
    )


def policy(rows: DataFrame, at: float = 0.5) -> DataFrame:
    """Per task the share of searches, the default action and the mean keyword length, rounded half to even."""
    df = checked(rows).where("ok")
    search = F.col("tag") == "search"
    mean = F.coalesce(F.avg(F.when(search, F.length("content"))), F.lit(0.0))
    ratio = F.avg(search.cast("double"))
    return df.groupBy("task").agg(F.count("*").alias("n"), F.round(ratio, 6).alias("search_ratio"), F.when(ratio >= at, "search").otherwise("final").alias("action"), F.bround(mean).cast("long").alias("keyword_length"))


def training_text(messages: Column, output: Column) -> Column:
    """Role blocks in order, then the output, with blank lines between."""
    blocks = F.transform(messages, lambda m: F.concat(F.lit("["), m["role"], F.lit("]\n"), m["content"]))
    return F.array_join(F.concat(blocks, F.array(F.concat(F.lit("[output]\n"), F.coalesce(output, F.lit(""))))), "\n\n")


def evidence_summary(documents: Column, most: int = 2, width: int = 180) -> Column:
    """The first documents, one to a line, cut with '...' beyond the width."""
    text = lambda e: T.safe_text(e["text"])
    cut = lambda t: F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("..."))).otherwise(t)
    return F.array_join(F.transform(F.slice(documents, 1, most), lambda e: F.concat(F.lit("["), F.coalesce(e["doc_id"], F.lit("")), F.lit("] "), cut(text(e)))), "\n")


def rule_action(task: Column, overlap: Column, step: Column, max_steps: Column, searching: list[str] | None = None) -> Column:
    """A student's action: search while steps are left and the task or a thin overlap calls for it."""
    return F.when((step < max_steps) & (task.isin(searching or ["multi_doc_qa"]) | (overlap < 2)), "search").otherwise("final")


def _asked(rows: DataFrame, model: Model, max_steps: int, repair: bool) -> DataFrame:
    """Adds output: the model's where ``ask``, else evidence as it is; other columns pass through."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("question", "evidence", "ask")]
            made = [model(q, e or "", 1, max_steps, repair) if ask else e for q, e, ask in zip(*own)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, pa.string())], names=[*batch.schema.names, "output"])

    return rows.mapInArrow(run, ", ".join(f"`{c}` {t}" for c, t in [*rows.dtypes, ("output", "string")]))


def taught(samples: DataFrame, model: Model = mock_model, system: str = "", repair: bool = True, drop: bool = True, max_steps: int = 4) -> DataFrame:
    """One row per sample (id, task, question, documents): the teacher's output, checked, repaired once, dropped if still bad.

    A repair shows the model its raw output in place of the evidence. ``invalid`` is of the first
    output, meta.repaired says that a repair was tried. A model that fails fails the run.
    The model is asked once per use of the result: persist it for both rows and rates.
    """
    ship_package(samples.sparkSession)
    question = F.coalesce("question", F.lit(""))
    user = F.concat(F.lit("Question:\n"), question, F.lit("\n\nEvidenceSummary:\n"), F.coalesce(evidence_summary(F.col("documents")), F.lit("")))
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    rows = samples.select("id", "task", question.alias("question"), F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), T.context(F.col("documents")).alias("evidence"), F.lit(True).alias("ask"))
    first = checked(_asked(rows, model, max_steps, False))
    again = first.select("id", "task", "question", "messages", F.col("output").alias("evidence"), (~F.col("ok") & F.lit(repair)).alias("ask"), (~F.col("ok")).alias("invalid"))
    last = checked(_asked(again, model, max_steps, True))
    tag, content = F.coalesce("tag", F.lit("final")), F.when(F.col("tag").isNull(), NO_ANSWER).otherwise(T.safe_text(F.col("content")))
    return last.select(
        "id", "task", "question", "messages", F.concat(F.lit("<"), tag, F.lit(">"), content, F.lit("</"), tag, F.lit(">")).alias("output"),
        F.struct(F.col("ask").alias("repaired"), F.col("reason").alias("quality_reason")).alias("meta"),
        tag.alias("tag"), "invalid", (F.col("ask") & F.col("ok")).alias("mended"), (~F.col("ok") & F.lit(drop)).alias("dropped"),
    )


def train_rows(taught_rows: DataFrame) -> DataFrame:
    """The rows that aren't dropped, as student_train has them."""
    return taught_rows.where("not dropped").select("id", "task", "question", "messages", "output", "meta")


def taught_rates(taught_rows: DataFrame) -> DataFrame:
    """One row: shares of invalid, mended and dropped of all, of search and final among kept, and kept rows by task."""
    kept = ~F.col("dropped")
    counts = [F.count("*").alias("total"), F.count_if(kept).alias("valid"), *(F.count_if(F.col(c)).alias(c) for c in ("invalid", "mended", "dropped")), *(F.count_if(kept & (F.col("tag") == t)).alias(t) for t in ("search", "final"))]
    per = taught_rows.groupBy(F.coalesce("task", F.lit("unknown")).alias("task")).agg(*counts)
    share = lambda c, of: F.round(F.coalesce(F.try_divide(F.sum(c), F.sum(of)), F.lit(0.0)), 6)
    by_task = F.collect_list(F.when(F.col("valid") > 0, F.struct("task", "valid")))
    return per.agg(
        F.coalesce(F.sum("total"), F.lit(0)).alias("total"), F.coalesce(F.sum("valid"), F.lit(0)).alias("valid"), share("invalid", "total").alias("invalid_rate"), share("mended", "total").alias("repaired_rate"), share("dropped", "total").alias("dropped_rate"),
        share("search", "valid").alias("search_ratio"), share("final", "valid").alias("final_ratio"), F.map_from_entries(F.array_sort(by_task)).alias("task_distribution"),
    )
