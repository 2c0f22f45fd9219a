"""Sliding windows over texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def guarded(size: int, overlap: int) -> tuple[int, int]:
    """Window size and overlap that make progress: 512 for a size of 0 or less, no negative overlap, a quarter for one too large."""
    size = size if size > 0 else 512
    overlap = max(0, overlap)
    return size, overlap if overlap < size else max(0, size // 4)


def windows(docs: DataFrame, size: int = 512, overlap: int = 128) -> DataFrame:
    """``sample_id, doc_id, chunk_id, offset_start, offset_end, text`` of docs (id, pos, doc_id, text).

    Windows start size - overlap apart and end with the text. Blank ones are dropped and
    not numbered; null and empty texts have none. Offsets count code points, the end
    excluded.
    """
    size, overlap = guarded(size, overlap)
    body = F.coalesce("text", F.lit(""))
    n = F.length(body)
    step = size - overlap
    last = F.greatest(F.ceil((n - size) / step), F.lit(0)).cast("int")
    starts = F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: (i * step).cast("int"))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda s: F.struct(s.alias("s"), F.least(s + size, n).alias("e"), F.substring(body, s + 1, F.lit(size)).alias("t")))
    # numbered within the row, so nothing is shuffled
    name = F.coalesce("doc_id", F.concat("id", F.lit("_d"), "pos"))
    pieces = docs.select(F.col("id").alias("sample_id"), name.alias("doc_id"), F.posexplode(F.filter(cut, lambda p: T.strip(p["t"]) != "")).alias("i", "p"))
    return pieces.select("sample_id", "doc_id", F.concat_ws("_", "sample_id", "doc_id", "i").alias("chunk_id"), F.col("p.s").alias("offset_start"), F.col("p.e").alias("offset_end"), F.col("p.t").alias("text"))
