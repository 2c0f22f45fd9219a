"""The pN_ queries of this subpackage: whole tables in, one DataFrame out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_values, spread_join
from ..session import checkpointed, table
from . import crosssplit, leaks, neardup, pairs, pieces, subjects, tokens
from .sql import SQL as SQL


def _records(spark: SparkSession, d: str) -> DataFrame:
    entry = table(spark, d, "minilongbench_tiny").select("id", F.explode("documents").alias("e"))
    samples = entry.select(F.lit("minilongbench_tiny").alias("grp"), F.concat("id", F.lit("_"), "e.doc_id").alias("key"), F.col("e.text").alias("text"))
    chunks = table(spark, d, "corpus_chunks").select(F.lit("corpus_chunks").alias("grp"), F.col("chunk_id").alias("key"), "text")
    return samples.unionByName(chunks)


def every_pair(records: DataFrame, threshold: float = 0.8, k: int = 8, least: int = 100, words: int = 5) -> DataFrame:
    """``grp, key_a, key_b`` (key_a < key_b): every pair of near-duplicate records of one group, copies included.

    The form that p1_found is given; as large as the pairs are many. ``neardup.near_groups``
    has one row per record.
    """
    near = checkpointed(neardup.similar_classes(records, threshold, k, least, words).select("a", "b"))
    member = checkpointed(neardup.members(records, least, words))
    hot = hot_values(member, "cid")
    a = member.select("grp", F.col("cid").alias("a"), F.col("key").alias("ka"))
    b = member.select(F.col("cid").alias("b"), F.col("key").alias("kb"))
    different = spread_join(spread_join(a, near, "a", hot), b, "b", hot).select("grp", "ka", "kb")
    same = spread_join(a, b.withColumnRenamed("b", "a"), "a", hot).where("ka < kb").select("grp", "ka", "kb")
    return different.unionByName(same).where("ka <> kb").select("grp", F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")).distinct()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of near-duplicate records: windows of 8 code points, overlap of at least 0.6."""
    return every_pair(_records(spark, d), 0.6, k=8, least=100, words=0).select(F.col("grp").alias("source_table"), "key_a", "key_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    """Each record with its class of equal texts and its group of near-duplicates (five words, 0.8)."""
    return neardup.near_groups(_records(spark, d), 0.8, words=5, least=1).select(F.col("grp").alias("source_table"), "key", "class_id", "group_id", "n_links")


def _oversized(spark: SparkSession, d: str) -> DataFrame:
    entry = table(spark, d, "minilongbench_tiny").select("id", F.explode("documents").alias("e"))
    samples = entry.select(F.lit("minilongbench_tiny").alias("source_table"), F.col("id").alias("sample_id"), F.col("e.doc_id").alias("item_id"), F.lit(0).alias("base"), F.lit(None).cast("int").alias("size"), F.lit(1200).alias("limit"), F.col("e.text").alias("text"))
    chunks = table(spark, d, "corpus_chunks").select(F.lit("corpus_chunks").alias("source_table"), "sample_id", F.col("chunk_id").alias("item_id"), F.coalesce("offset_start", F.lit(0)).alias("base"), (F.col("offset_end") - F.col("offset_start")).alias("size"), F.lit(512).alias("limit"), "text")
    return pieces.pieces(samples.unionByName(chunks))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Oversized items and whether some piece had to be cut without a boundary."""
    return _oversized(spark, d).select("source_table", "sample_id", "item_id", pieces.cut_kind(F.col("kinds")).alias("cut_kind")).distinct()


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The offsets of the pieces of each oversized item, and what each repeats of the one before.

    Of repeated items that differ the one with the greatest pieces in order is kept.
    """
    once = _oversized(spark, d).groupBy("source_table", "sample_id", "item_id").agg(F.max(F.struct("base", "starts", "ends", "kinds")).alias("r")).select("source_table", "sample_id", "item_id", "r.*")
    return pieces.exploded(once).select("source_table", "sample_id", "item_id", "piece", (F.col("base") + F.col("piece_start")).alias("offset_start"), (F.col("base") + F.col("piece_end")).alias("offset_end"), "overlap", "kind")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a training sample and a valid or test sample that are the same or almost so."""
    found = crosssplit.overlaps(table(spark, d, "minilongbench_tiny").select("id", "question", "documents", "prepared_at"))
    return found.select(F.least("train_id", "held_id").alias("id_a"), F.greatest("train_id", "held_id").alias("id_b"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping samples per held-out split and source."""
    samples = table(spark, d, "minilongbench_tiny")
    sources = samples.groupBy("id").agg(F.max(tokens.source_label(F.col("meta")["dataset"])).alias("source"))
    return crosssplit.report(crosssplit.overlaps(samples.select("id", "question", "documents", "prepared_at")), sources)


def p4_token_cube(spark: SparkSession, d: str) -> DataFrame:
    """Tokens of both corpora by source, language and task, with all subtotals."""
    documents = table(spark, d, "documents").select(
        F.lit("documents").alias("corpus"), F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("pos"), F.lit(None).cast("timestamp").alias("at"), tokens.source_label(F.col("source")).alias("source"), tokens.language_label(F.col("lang")).alias("language"), tokens.source_label(F.col("task")).alias("task"), "text"
    )
    samples = table(spark, d, "minilongbench_tiny").select("id", "task", "meta", F.col("prepared_at").alias("at"), F.posexplode("documents").alias("pos", "e"))
    samples = samples.select(
        F.lit("minilongbench_tiny").alias("corpus"), "id", "pos", "at", tokens.source_label(F.col("meta")["dataset"]).alias("source"), tokens.language_label(F.col("meta")["language"]).alias("language"), tokens.source_label(F.col("task")).alias("task"), F.col("e.text").alias("text")
    )
    plain = tokens.token_counts(documents).drop("id", "pos", "at")
    # a repeated sample counts once, as last prepared; the counts move for that, not the texts
    latest = tokens.token_counts(samples).groupBy("corpus", "id", "pos").agg(F.max_by(F.struct("source", "language", "task", "n_chars", "n_tokens"), F.coalesce("at", F.lit("1970-01-01").cast("timestamp"))).alias("r"))
    return tokens.budget_cube(plain.unionByName(latest.select("corpus", "r.*")))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    student = table(spark, d, "student_train").select(F.lit("student_train").alias("source_table"), "id", "question", F.col("output").alias("answer")).groupBy("source_table", "id").agg(F.max(F.struct("question", "answer")).alias("r")).select("source_table", "id", "r.*")
    # of a repeated id the latest row, and of equal times the greatest value, in any run
    last = lambda value, at: F.max(F.struct(F.coalesce(F.col(at), F.lit("1970-01-01").cast("timestamp")).alias("at"), F.col(value).alias("v")))["v"]
    latest = table(spark, d, "baseline_rag").groupBy("id").agg(last("pred", "appended_at").alias("answer"))
    asked = table(spark, d, "minilongbench_tiny").groupBy("id").agg(last("question", "prepared_at").alias("question"))
    rag = latest.join(asked, "id", "left").select(F.lit("baseline_rag").alias("source_table"), "id", "question", "answer")
    return pairs.defects(student.unionByName(rag))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Each defective answer with the first defect in the rules' order."""
    return _answers(spark, d).where(F.size("defects") > 0).select("source_table", "id", F.col("defects")[0].alias("defect"))


def p5_defects(spark: SparkSession, d: str) -> DataFrame:
    """Every triggered defect of every answer."""
    return _answers(spark, d).select("source_table", "id", F.explode("defects").alias("defect"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of each document by byte_bpe_50k."""
    return tokens.encode(table(spark, d, "documents"))


#: Share of an item that a document must hold for a row of p7_leaks; p7_found takes any run.
LEAST_COVERAGE = 0.25


def _leaked(spark: SparkSession, d: str, least: float) -> DataFrame:
    return leaks.leaked(leaks.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")), least)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold a run of an evaluation item's passage or question."""
    return _leaked(spark, d, 0.0).select("doc_id", "item_id").distinct()


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    """How much of each item's passage and question each document holds, and in what order, where tiles cover a quarter or more."""
    return _leaked(spark, d, LEAST_COVERAGE).select("doc_id", "item_id", "part", "longest", "tiles", "covered", "coverage", "verdict")


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    named = [r.subject for r in table(spark, d, "subjects").where("subject is not null").select("subject").distinct().orderBy("subject").limit(subjects.MOST_SUBJECTS + 1).collect()]
    if len(named) > subjects.MOST_SUBJECTS:
        raise ValueError(f"more than {subjects.MOST_SUBJECTS} subjects")
    sample = subjects.labelled_sample(documents, table(spark, d, "doc_labels"), named)
    return subjects.assign(documents, subjects.train(*sample, named, spread=subjects.spread_over(spark)))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """The subject areas of each document."""
    return _subjects(spark, d).select("doc_id", "subject")


def p8_composition(spark: SparkSession, d: str) -> DataFrame:
    """Documents and code points of the corpus by subject; a document counts for each of its subjects."""
    sizes = table(spark, d, "documents").select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n"))
    named = sizes.join(_subjects(spark, d).select("doc_id", "subject"), "doc_id", "left")
    return named.groupBy(F.coalesce("subject", F.lit("(none)")).alias("subject")).agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_chars"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_groups": p1_groups,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p3_found": p3_found,
    "p3_report": p3_report,
    "p4_token_cube": p4_token_cube,
    "p5_found": p5_found,
    "p5_defects": p5_defects,
    "p6_ids": p6_ids,
    "p7_found": p7_found,
    "p7_leaks": p7_leaks,
    "p8_found": p8_found,
    "p8_composition": p8_composition,
}
