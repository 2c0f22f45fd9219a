"""What the queries share: records once each, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.sampling import first_wins
from ..session import table

#: White space for DuckDB, as loomspan.functions.text.WS.
W = r"[\s\x0B\x{85}\p{Z}]"

SAMPLES = "samples AS (SELECT * FROM minilongbench_tiny QUALIFY row_number() OVER (PARTITION BY id ORDER BY prepared_at DESC NULLS LAST) = 1)"
DOCS = "docs AS (SELECT id, CAST(p - 1 AS INT) AS pos, e.doc_id AS doc_id, e.text AS text FROM (SELECT id, unnest(documents) AS e, generate_subscripts(documents, 1) AS p FROM samples))"
PREDS = "preds AS (SELECT * FROM baseline_rag QUALIFY row_number() OVER (PARTITION BY id ORDER BY appended_at DESC NULLS LAST) = 1)"
CHUNKS = "chunks AS (SELECT DISTINCT * FROM corpus_chunks)"


def sql_strip(c: str) -> str:
    return f"regexp_replace(coalesce({c}, ''), '^{W}+|{W}+$', '', 'g')"


def sql_scored(c: str) -> str:
    return f"""regexp_replace(regexp_replace(lower(coalesce({c}, '')), '{W}+', '', 'g'), '[，。！？、,.!?;:"''`（）()\\[\\]{{}}<>《》]', '', 'g')"""


def sql_query_tokens(c: str) -> str:
    return f"regexp_extract_all(lower(coalesce({c}, '')), '([a-z0-9_]+|[一-鿿])', 1)"


def sql_chars(c: str) -> str:
    return f"list_filter(string_split({c}, ''), lambda x: x <> '')"


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Each sample as last prepared."""
    return first_wins(table(spark, d, "minilongbench_tiny"), "id", F.col("prepared_at").desc_nulls_last())


def docs(spark: SparkSession, d: str) -> DataFrame:
    """One row per document of each sample, with its place."""
    return samples(spark, d).select("id", F.posexplode("documents").alias("pos", "e")).select("id", "pos", "e.doc_id", "e.text")


def preds(spark: SparkSession, d: str) -> DataFrame:
    """Each prediction as last appended."""
    return first_wins(table(spark, d, "baseline_rag"), "id", F.col("appended_at").desc_nulls_last())


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "corpus_chunks").distinct()


def numbered(df: DataFrame, *order) -> DataFrame:
    return df.withColumn("rn", F.row_number().over(Window.orderBy(*order)))
