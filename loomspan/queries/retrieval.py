"""Chunking and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chunks as windows
from ..operators import memory, retrieve
from ..registry import query
from ..session import table
from .base import CHUNKS, DOCS, SAMPLES, W, chunks, docs, samples, sql_query_tokens, sql_strip
from .text import SQL_KIND

_BAG = f"CASE WHEN contains(t, ' ') THEN list_filter(string_split(t, ' '), lambda x: x <> '') ELSE list_filter(string_split(t, ''), lambda x: x <> '' AND NOT regexp_full_match(x, '{W}')) END"
QUERIES = "queries AS (SELECT id AS qid, id AS sample_id, question FROM samples)"
_INDEX = (
    f"qb AS (SELECT qid, sample_id, token, count(*) AS qn FROM (SELECT qid, sample_id, unnest({_BAG}) AS token FROM (SELECT qid, sample_id, lower({sql_strip('question')}) AS t FROM queries)) GROUP BY ALL), "
    f"cb AS (SELECT chunk_id, sample_id, token, count(*) AS cn FROM (SELECT chunk_id, sample_id, unnest({_BAG}) AS token FROM (SELECT chunk_id, sample_id, lower({sql_strip('text')}) AS t FROM chunks)) GROUP BY ALL)"
)
LEXICAL = (
    f"{_INDEX}, qs AS (SELECT qid, sum(qn * qn) AS qs FROM qb GROUP BY qid), cs AS (SELECT chunk_id, sum(cn * cn) AS cs FROM cb GROUP BY chunk_id), "
    "lex AS (SELECT qid, chunk_id, round(common / sqrt((qs * cs)::DOUBLE), 6) AS score FROM (SELECT qid, chunk_id, sum(least(qn, cn)) AS common FROM qb JOIN cb USING (sample_id, token) GROUP BY ALL) JOIN qs USING (qid) JOIN cs USING (chunk_id))"
)
_DENSE = (
    "qv AS (SELECT qid, sample_id, dim, sum(qn) AS n FROM (SELECT *, ('0x' || substring(md5(token), 1, 8))::BIGINT % 64 AS dim FROM qb) GROUP BY ALL), cv AS (SELECT chunk_id, sample_id, dim, sum(cn) AS n FROM (SELECT *, ('0x' || substring(md5(token), 1, 8))::BIGINT % 64 AS dim FROM cb) GROUP BY ALL), "
    "qu AS (SELECT qid, sample_id, dim, n / sqrt((sum(n * n) OVER (PARTITION BY qid))::DOUBLE) AS qx FROM qv), cu AS (SELECT chunk_id, sample_id, dim, n / sqrt((sum(n * n) OVER (PARTITION BY chunk_id, sample_id))::DOUBLE) AS cx FROM cv), "
    "den AS (SELECT qid, chunk_id, round(sum(qx * cx), 6) AS score FROM qu JOIN cu USING (sample_id, dim) GROUP BY ALL)"
)


def _rank(source: str, most: int) -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS rank FROM {source}) WHERE rank <= {most}"


def _fused_sql() -> str:
    return (
        f"a AS ({_rank('den', 20)}), b AS ({_rank('lex', 20)}), "
        "f AS (SELECT coalesce(a.qid, b.qid) AS qid, coalesce(a.chunk_id, b.chunk_id) AS chunk_id, least(1.0, greatest(0.0, (coalesce(a.score, 0.0) + 1) / 2)) AS score_dense, least(1.0, greatest(0.0, coalesce(b.score, 0.0))) AS score_lexical FROM a FULL JOIN b ON a.qid = b.qid AND a.chunk_id = b.chunk_id), "
        "g AS (SELECT *, round(score_dense * 0.65::DOUBLE + score_lexical * 0.35::DOUBLE, 9) AS score FROM f)"
    )


def _questions(spark, d):
    return samples(spark, d).select(F.col("id").alias("qid"), F.col("id").alias("sample_id"), "question")


@query(
    f"WITH {SAMPLES}, {DOCS}, n AS (SELECT id, pos, coalesce(doc_id, id || '_d' || pos) AS doc_id, text, length(text) AS n FROM docs WHERE length(coalesce(text, '')) > 0), "
    "s AS (SELECT *, unnest(range(0, greatest(ceil((n - 512) / 384.0), 0)::BIGINT + 1)) * 384 AS a FROM n), p AS (SELECT *, least(a + 512, n) AS b, substring(text, (a + 1)::BIGINT, (least(a + 512, n) - a)::BIGINT) AS piece FROM s), "
    f"k AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY a) - 1 AS i FROM p WHERE {sql_strip('piece')} <> '') "
    "SELECT id AS sample_id, doc_id, id || '_' || doc_id || '_' || i AS chunk_id, a::INT AS offset_start, b::INT AS offset_end, piece AS text FROM k"
)
def chunk_windows(spark, d):
    return windows.windows(docs(spark, d))


@query(f"WITH {SAMPLES}, {CHUNKS}, {QUERIES}, {LEXICAL}, allp AS (SELECT q.qid, c.chunk_id, coalesce(lex.score, 0.0) AS score FROM queries q JOIN chunks c USING (sample_id) LEFT JOIN lex ON lex.qid = q.qid AND lex.chunk_id = c.chunk_id) {_rank('allp', 5)}")
def lexical_score_topk(spark, d):
    return retrieve.lexical_top_k(_questions(spark, d), chunks(spark, d))


@query(
    f"WITH {CHUNKS}, queries AS (SELECT item_id AS qid, 0 AS sample_id, question FROM eval_items WHERE item_id % 50 = 0), {LEXICAL.replace('SELECT chunk_id, sample_id,', 'SELECT chunk_id, 0 AS sample_id,').replace('(SELECT chunk_id, 0 AS sample_id, lower', '(SELECT chunk_id, lower')} {_rank('lex', 5)}"
)
def lexical_global_topk(spark, d):
    asked = table(spark, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), "question")
    return retrieve.search("lexical", asked, chunks(spark, d), scope=None)


_POOL = (
    f"WITH {CHUNKS}, queries AS (SELECT item_id AS qid, 0 AS sample_id, question FROM eval_items WHERE item_id % 50 = 0), {LEXICAL.replace('SELECT chunk_id, sample_id,', 'SELECT chunk_id, 0 AS sample_id,').replace('(SELECT chunk_id, 0 AS sample_id, lower', '(SELECT chunk_id, lower')}, "
    + _DENSE
)


@query(f"{_POOL} {_rank('den', 5)}")
def dense_global_topk(spark, d):
    asked = table(spark, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), "question")
    return retrieve.search("dense", asked, chunks(spark, d), scope=None)


@query(f"{_POOL}, {_fused_sql()} {_rank('g', 5)}")
def hybrid_global_topk(spark, d):
    asked = table(spark, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("qid"), "question")
    return retrieve.search("hybrid", asked, chunks(spark, d), scope=None)


@query(
    "WITH q AS (SELECT vec_id AS qid, embedding AS e FROM embeddings WHERE vec_id % 50 = 0), s AS (SELECT qid, v.vec_id, round(list_inner_product(e::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM q JOIN embeddings v ON v.vec_id <> qid) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5"
)
def dense_topk(spark, d):
    vectors = table(spark, d, "embeddings")
    return retrieve.dense_top_k(vectors, vectors.where("vec_id % 50 = 0"))


@query(f"WITH {SAMPLES}, {CHUNKS}, {QUERIES}, {LEXICAL}, {_DENSE} {_rank('den', 5)}")
def dense_hashed_topk(spark, d):
    return retrieve.search("dense", _questions(spark, d), chunks(spark, d))


@query(
    f"WITH {SAMPLES}, {CHUNKS}, {QUERIES}, {LEXICAL}, {_DENSE}, {_fused_sql()} {_rank('g', 5)}"
)
def hybrid_topk(spark, d):
    return retrieve.search("hybrid", _questions(spark, d), chunks(spark, d))


@query("SELECT chunk_id, sample_id, max(length(text))::DOUBLE AS score FROM corpus_chunks GROUP BY ALL")
def hybrid_dedup(spark, d):
    scored = table(spark, d, "corpus_chunks").select("sample_id", "chunk_id", F.length("text").cast("double").alias("score"))
    return retrieve.best_per_key(scored, "sample_id")


@query(
    f"WITH {SAMPLES}, {CHUNKS}, b AS (SELECT s.id AS qid, c.chunk_id, len(list_filter(list_distinct({sql_query_tokens('s.question')}), lambda t: contains(lower(coalesce(c.text, '')), t)))::BIGINT AS hits, length(coalesce(c.text, ''))::BIGINT AS size FROM samples s JOIN chunks c ON c.sample_id = s.id) "
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY hits DESC, size DESC, chunk_id) AS rank FROM b) WHERE rank <= 3"
)
def fallback_rank(spark, d):
    return retrieve.fallback_rank(_questions(spark, d), chunks(spark, d))


_HITS = f"hits AS (SELECT c.sample_id, c.chunk_id, c.text, s.question, row_number() OVER (PARTITION BY c.sample_id ORDER BY c.chunk_id) - 1 AS pos FROM chunks c JOIN samples s ON s.id = c.sample_id)"


def _hits(spark, d):
    own = chunks(spark, d).join(samples(spark, d).select(F.col("id").alias("sample_id"), "question"), "sample_id")
    return memory.positioned(own)


@query(
    f"WITH {SAMPLES}, {CHUNKS}, {_HITS}, t AS (SELECT sample_id, chunk_id, pos, greatest(1, length(coalesce(text, '')) // 2)::BIGINT AS tokens, (pos % 3)::BIGINT AS support, (length(coalesce(text, '')) % 7) / 7.0::DOUBLE AS score FROM hits), "
    "w AS (SELECT *, sum(tokens) OVER (PARTITION BY sample_id) - coalesce(sum(tokens) OVER (PARTITION BY sample_id ORDER BY support, score, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest, "
    "sum(tokens) OVER (PARTITION BY sample_id) - coalesce(sum(tokens) OVER (PARTITION BY sample_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest_old FROM t) "
    "SELECT sample_id, chunk_id, rest > 600 AS dropped, rest_old > 600 AS dropped_sliding FROM w"
)
def memory_prune(spark, d):
    n = F.length(F.coalesce("text", F.lit("")))
    hits = _hits(spark, d).withColumns({"tokens": T.approx_tokens(F.col("text"), 1), "support": F.col("pos") % 3, "score": (n % 7) / F.lit(7.0)})
    both = memory.pruned(memory.pruned(hits, 600).withColumnRenamed("dropped", "kept_first"), 600, "sliding")
    return both.select("sample_id", "chunk_id", F.col("kept_first").alias("dropped"), F.col("dropped").alias("dropped_sliding"))


@query(
    f"WITH {SAMPLES}, {CHUNKS}, f AS (SELECT sample_id, chunk_id, row_number() OVER (PARTITION BY sample_id ORDER BY chunk_id) AS m FROM chunks WHERE {sql_strip('text')} <> '') SELECT c.sample_id, c.chunk_id, coalesce(s.support, 0)::BIGINT AS support "
    "FROM chunks c LEFT JOIN (SELECT sample_id, chunk_id, count(*) AS support FROM f WHERE m <= 3 GROUP BY ALL) s USING (sample_id, chunk_id)"
)
def fact_support(spark, d):
    own = chunks(spark, d)
    resting = memory.support(memory.facts(own.withColumn("score", F.lit(0.5))))
    return own.select("sample_id", "chunk_id").join(resting, ["sample_id", "chunk_id"], "left").select("sample_id", "chunk_id", F.coalesce("support", F.lit(0)).alias("support"))


_BEST = f"r AS (SELECT *, len(list_filter({sql_query_tokens('question')}, lambda t: contains(lower(coalesce(text, '')), t)))::INT AS n FROM hits), b AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY n DESC, pos) AS rn FROM r)"


@query(f"WITH {SAMPLES}, {CHUNKS}, {_HITS}, {_BEST} SELECT sample_id, chunk_id, n AS hits FROM b WHERE rn = 1")
def best_chunk(spark, d):
    return memory.best_chunks(_hits(spark, d)).select("sample_id", "chunk_id", "hits")


_NUM = r"regexp_replace(replace(regexp_extract(coalesce(text, ''), '(^|[^a-zA-Z0-9_])(-?\d+(?:[.,]\d+)?)', 2), ',', ''), '\.0$', '')"
_PAR = r"coalesce(nullif(regexp_extract(coalesce(text, ''), '(?i)\bparagraph\s*(\d+)\b', 1), ''), nullif(regexp_extract(coalesce(text, ''), '(?i)\bpara\s*(\d+)\b', 1), ''), nullif(regexp_extract(coalesce(text, ''), '段落\s*(\d+)', 1), ''), nullif(regexp_extract(coalesce(text, ''), '第\s*(\d+)\s*段', 1), ''))"


@query(
    f"WITH {SAMPLES}, {CHUNKS}, {_HITS}, {_BEST}, x AS (SELECT *, nullif({_NUM}, '') AS num, {_PAR} AS par FROM b), "
    "first_num AS (SELECT sample_id, arg_min(num, pos) AS any_num FROM x WHERE num IS NOT NULL GROUP BY sample_id), first_par AS (SELECT sample_id, arg_min(par, pos) AS any_par FROM x WHERE par IS NOT NULL GROUP BY sample_id), "
    f"y AS (SELECT x.sample_id, question, {sql_strip('text')} AS t, lower({sql_strip('question')}) AS q, coalesce(num, any_num) AS num, coalesce(par, any_par) AS par FROM x LEFT JOIN first_num USING (sample_id) LEFT JOIN first_par USING (sample_id) WHERE rn = 1), "
    f"z AS (SELECT *, {SQL_KIND} AS kind, {sql_strip('''regexp_split_to_array(t, '[\\n。！？!?]')[1]''')} AS f FROM y), "
    "e AS (SELECT *, regexp_replace(CASE WHEN f = '' THEN t ELSE f END, '^[ \"''`:,;：；]+|[ \"''`:,;：；]+$', '', 'g') AS ent, CASE WHEN length(t) > 96 THEN regexp_replace(substring(t, 1, 96), '[ ,:;：；]+$', '') ELSE t END AS cut FROM z), "
    "w AS (SELECT sample_id, kind, CASE kind WHEN 'count' THEN num WHEN 'paragraph_id' THEN CASE WHEN par IS NULL THEN NULL WHEN regexp_matches(question, '[一-鿿]') THEN '段落' || par ELSE 'Paragraph ' || par END "
    "WHEN 'entity_short' THEN CASE WHEN length(ent) > 48 THEN regexp_replace(substring(ent, 1, 48), '[ ,:;：；]+$', '') ELSE ent END END AS found, cut FROM e) "
    f"SELECT sample_id, kind, CASE WHEN {sql_strip('''coalesce(nullif(found, ''), cut)''')} = '' THEN 'Not enough information to answer.' ELSE {sql_strip('''coalesce(nullif(found, ''), cut)''')} END AS answer FROM w"
)
def best_answer(spark, d):
    return memory.best_answers(_hits(spark, d), T.answer_kind(F.col("question")))
