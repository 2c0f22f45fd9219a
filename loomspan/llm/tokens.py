"""Token budgets and encodings of whole corpora under a public vocabulary."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread
from . import bpe, cores

ALL = "(all)"


def source_label(c: Column) -> Column:
    """Lower case without surrounding space; null and blank become 'unknown'."""
    return F.coalesce(F.nullif(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), F.lit("")), F.lit("unknown"))


def language_label(c: Column) -> Column:
    """The primary language subtag in lower case; null and blank become 'und'."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(c), r"^\s*([a-z]+)", 1), F.lit("")), F.lit("und"))


def token_counts(texts: DataFrame, vocabulary: str = bpe.BYTE_BPE_50K, folder: str = bpe.FOLDER) -> DataFrame:
    """``texts`` with its last column, text, replaced by n_chars and n_tokens.

    Counts are exact: no id is made. Null and empty texts have 0 of both.
    """
    ship_package(texts.sparkSession)
    body = bpe.read_vocabulary(vocabulary, folder)
    kept = texts.drop("text")
    names = [*kept.columns, "n_chars", "n_tokens"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.vocabulary(body)
        for batch in batches:
            values = batch.column(batch.num_columns - 1).to_pylist()
            columns = [*batch.columns[:-1], pa.array([len(t or "") for t in values], pa.int64()), pa.array([own.count(t) for t in values], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    fields = ", ".join(f"`{n}` {t}" for n, t in kept.dtypes)
    return spread(texts.select(*kept.columns, "text")).mapInArrow(run, f"{fields}, n_chars long, n_tokens long")


def budget_cube(counted: DataFrame) -> DataFrame:
    """Totals of each corpus over every combination of source, language and task.

    '(all)' stands for a dimension summed over. Needs corpus, source, language, task,
    n_chars and n_tokens; an empty input gives no row.
    """
    sums = [F.count("*").alias("n_texts"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"), F.sum((F.col("n_tokens") > 0).cast("long")).alias("n_with_text")]
    fine = counted.groupBy("corpus", "source", "language", "task").agg(*sums)
    cube = fine.cube("corpus", "source", "language", "task").agg(
        *(F.sum(c).alias(c) for c in ("n_texts", "n_chars", "n_tokens", "n_with_text")), *(F.grouping(c).alias(f"g_{c}") for c in ("corpus", "source", "language", "task"))
    )
    shown = [F.when(F.col(f"g_{c}") == 1, ALL).otherwise(F.col(c)).alias(c) for c in ("source", "language", "task")]
    return cube.where("g_corpus = 0").select("corpus", *shown, "n_texts", "n_with_text", "n_chars", "n_tokens")


def encode(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = bpe.BYTE_BPE_50K, folder: str = bpe.FOLDER, leaf: int = bpe.LEAF, threads: int = 2) -> DataFrame:
    """``key, ids``: each text's token ids, without special tokens.

    Null and empty texts have an empty list. Every text is a tree of leaves of up to
    ``leaf`` code points, which ``threads`` threads encode and which are concatenated; see
    ``bpe.Vocabulary.ids``. One pass, no shuffle. Equal keys keep their rows apart.
    """
    ship_package(documents.sparkSession)
    body = bpe.read_vocabulary(vocabulary, folder)
    kind = dict(documents.dtypes)[key]

    def lists(ids: list) -> pa.Array:
        offsets = np.zeros(len(ids) + 1, np.int32)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        flat = np.concatenate([np.asarray(x, np.int32) for x in ids]) if ids else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe.vocabulary(body)
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for lo, hi in cores.blocks(texts):
                    part = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column(0), lists([own.ids(t, leaf, pool) for t in texts[lo:hi]])], names=["k", "ids"])

    rows = spread(documents.select(F.col(key).alias("k"), F.col(text).alias("t")))
    return rows.mapInArrow(run, f"k {kind}, ids array<int>").select(F.col("k").alias(key), "ids")
