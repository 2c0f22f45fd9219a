"""Projections over questions, answers and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..registry import query
from ..session import table
from .base import CHUNKS, DOCS, PREDS, SAMPLES, W, chunks, preds, samples, sql_query_tokens, sql_scored, sql_strip

STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)


def _markers(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


_KIND_CASES = " ".join(f"WHEN {_markers('q', words)} THEN '{kind}'" for kind, words in T.QUESTION_KINDS.items())
SQL_KIND = f"CASE WHEN q = '' THEN 'open_text' {_KIND_CASES} ELSE 'open_text' END"


@query(f"WITH {DOCS.replace('samples', 'minilongbench_tiny')} SELECT DISTINCT id, doc_id, {sql_strip('text')} AS clean FROM docs")
def safe_text(spark, d):
    rows = table(spark, d, "minilongbench_tiny").select("id", F.explode("documents").alias("e"))
    return rows.select("id", F.col("e.doc_id").alias("doc_id"), T.safe_text(F.col("e.text")).alias("clean")).distinct()


@query(f"WITH {PREDS} SELECT id, {sql_scored('pred')} AS p, {sql_scored('gold')} AS g FROM preds")
def normalize_scored(spark, d):
    return preds(spark, d).select("id", T.scored(F.col("pred")).alias("p"), T.scored(F.col("gold")).alias("g"))


@query(f"WITH {SAMPLES} SELECT id, CASE WHEN answer IS NULL OR length(answer) = 0 THEN 0 ELSE greatest(1, length(answer) // 2) END::BIGINT AS n, CASE WHEN question IS NULL OR length(question) = 0 THEN 1 ELSE greatest(1, length(question) // 2) END::BIGINT AS m FROM samples")
def approx_tokens(spark, d):
    return samples(spark, d).select("id", T.approx_tokens(F.col("answer")).alias("n"), T.approx_tokens(F.col("question"), 1).alias("m"))


@query(f"WITH {CHUNKS}, t AS (SELECT chunk_id, lower({sql_strip('text')}) AS t FROM chunks) SELECT chunk_id, coalesce(array_to_string(CASE WHEN contains(t, ' ') THEN list_filter(string_split(t, ' '), lambda x: x <> '') ELSE list_filter(string_split(t, ''), lambda x: x <> '' AND NOT regexp_full_match(x, '{W}')) END, '|'), '') AS tokens FROM t")
def token_list(spark, d):
    return chunks(spark, d).select("chunk_id", F.array_join(T.bag_tokens(F.col("text")), "|").alias("tokens"))


@query(f"WITH {CHUNKS}, t AS (SELECT chunk_id, lower({sql_strip('text')}) AS t FROM chunks), u AS (SELECT chunk_id, unnest(CASE WHEN contains(t, ' ') THEN list_filter(string_split(t, ' '), lambda x: x <> '') ELSE list_filter(string_split(t, ''), lambda x: x <> '' AND NOT regexp_full_match(x, '{W}')) END) AS token FROM t) SELECT chunk_id, token, count(*) AS n FROM u GROUP BY ALL")
def token_bag(spark, d):
    return chunks(spark, d).select("chunk_id", F.explode(T.bag_tokens(F.col("text"))).alias("token")).groupBy("chunk_id", "token").agg(F.count("*").alias("n"))


@query(f"WITH {SAMPLES} SELECT id, coalesce(array_to_string({sql_query_tokens('question')}, '|'), '') AS tokens, coalesce(array_to_string(list_filter({sql_query_tokens('question')}, lambda x: x NOT IN ({STOP})), '|'), '') AS kept FROM samples")
def query_token_lists(spark, d):
    return samples(spark, d).select("id", F.array_join(T.query_tokens(F.col("question")), "|").alias("tokens"), F.array_join(T.keyword_tokens(F.col("question")), "|").alias("kept"))


@query(f"WITH {SAMPLES} SELECT id, regexp_replace(lower({sql_strip('question')}), '{W}+', ' ', 'g') AS keyword FROM samples")
def keyword_normalize(spark, d):
    return samples(spark, d).select("id", T.squeezed(F.col("question")).alias("keyword"))


@query(
    f"WITH {SAMPLES}, t AS (SELECT id, question, answer, {sql_query_tokens('question')} AS q, list_concat({sql_query_tokens('question')}, {sql_query_tokens('answer')}) AS a FROM samples), "
    "u AS (SELECT id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM t), "
    "f AS (SELECT id, x, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM f), "
    "j AS (SELECT id, string_agg(x, ' ' ORDER BY i) AS s FROM r WHERE n <= 10 GROUP BY id) "
    f"SELECT t.id, coalesce(j.s, nullif({sql_strip('t.answer')}, ''), {sql_strip('t.question')}) AS rewritten FROM t LEFT JOIN j USING (id)"
)
def query_rewrite(spark, d):
    return samples(spark, d).select("id", T.rewritten(F.col("question"), F.col("answer")).alias("rewritten"))


@query(
    f"WITH {SAMPLES}, t AS (SELECT id, question, {sql_query_tokens('question')} AS a FROM samples), u AS (SELECT id, unnest(a) AS x, unnest(range(1, len(a) + 1)) AS i FROM t), "
    "f AS (SELECT id, x, min(i) AS i FROM u GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY i) AS n FROM f), "
    "j AS (SELECT id, string_agg(x, ' ' ORDER BY i) AS s FROM r WHERE n <= 8 GROUP BY id) "
    f"SELECT t.id, coalesce(j.s, {sql_strip('t.question')}) AS forced FROM t LEFT JOIN j USING (id)"
)
def forced_keyword(spark, d):
    return samples(spark, d).select("id", T.forced_keyword(F.col("question"), F.lit("")).alias("forced"))


@query(f"WITH {SAMPLES}, t AS (SELECT id, list_filter({sql_query_tokens('question')}, lambda x: x NOT IN ({STOP}))[1:4] AS k FROM samples) SELECT id, CASE WHEN len(k) > 0 THEN array_to_string(k, ' ') ELSE '关键信息' END AS keyword FROM t")
def first_keywords(spark, d):
    return samples(spark, d).select("id", T.first_keywords(F.col("question")).alias("keyword"))


@query(f"WITH {SAMPLES}, t AS (SELECT id, lower({sql_strip('question')}) AS q FROM samples) SELECT id, {SQL_KIND} AS kind FROM t")
def answer_type(spark, d):
    return samples(spark, d).select("id", T.answer_kind(F.col("question")).alias("kind"))


@query(
    f"WITH {SAMPLES}, {DOCS}, t AS (SELECT d.id, list_distinct({sql_query_tokens('s.question')}) AS q, {sql_query_tokens('d.text')} AS c FROM docs d JOIN samples s USING (id)) "
    "SELECT id, max(CASE WHEN len(q) = 0 THEN 0.0 ELSE len(list_filter(q, lambda x: list_contains(c, x)))::DOUBLE / len(q) END) AS overlap FROM t GROUP BY id"
)
def evidence_overlap(spark, d):
    own = samples(spark, d).select("id", "question", F.explode("documents").alias("e"))
    return own.groupBy("id").agg(F.max(T.evidence_overlap(F.col("question"), F.col("e.text"))).alias("overlap"))


_NUMBER = r"(^|[^a-zA-Z0-9_])(-?\d+(?:[.,]\d+)?)"


@query(f"WITH {CHUNKS} SELECT chunk_id, regexp_replace(replace(regexp_extract(coalesce(text, ''), '{_NUMBER}', 2), ',', ''), '\\.0$', '') AS number FROM chunks")
def extract_number(spark, d):
    return chunks(spark, d).select("chunk_id", T.first_number(F.col("text")).alias("number"))


@query(
    f"WITH {SAMPLES}, t AS (SELECT id, 'see ' || CASE length(id) % 4 WHEN 0 THEN 'Paragraph 12' WHEN 1 THEN 'para 7' WHEN 2 THEN '第 3 段' ELSE 'no' END || ' ' || coalesce(answer, '') AS t FROM samples) "
    "SELECT id, coalesce(nullif(regexp_extract(t, '(?i)\\bparagraph\\s*(\\d+)\\b', 1), ''), nullif(regexp_extract(t, '(?i)\\bpara\\s*(\\d+)\\b', 1), ''), nullif(regexp_extract(t, '段落\\s*(\\d+)', 1), ''), nullif(regexp_extract(t, '第\\s*(\\d+)\\s*段', 1), ''), '') AS paragraph FROM t"
)
def extract_paragraph(spark, d):
    n = F.length("id") % 4
    named = F.when(n == 0, "Paragraph 12").when(n == 1, "para 7").when(n == 2, "第 3 段").otherwise("no")
    return samples(spark, d).select("id", T.paragraph_number(F.concat(F.lit("see "), named, F.lit(" "), F.coalesce("answer", F.lit("")))).alias("paragraph"))


@query(
    f"WITH {PREDS}, t AS (SELECT id, {sql_strip('pred')} AS s, {sql_strip('''regexp_split_to_array(''' + sql_strip('pred') + ''', '[\\n。！？!?]')[1]''')} AS f FROM preds), "
    "u AS (SELECT id, regexp_replace(CASE WHEN f = '' THEN s ELSE f END, '^[ \"''`:,;：；]+|[ \"''`:,;：；]+$', '', 'g') AS e FROM t) "
    "SELECT id, CASE WHEN length(e) > 48 THEN regexp_replace(substring(e, 1, 48), '[ ,:;：；]+$', '') ELSE e END AS entity FROM u"
)
def extract_entity(spark, d):
    return preds(spark, d).select("id", T.short_entity(F.col("pred")).alias("entity"))


_CUT = " OR ".join(f"ends_with(l, '{t}')" for t in T.CUT_TAILS)


@query(
    f"WITH {SAMPLES}, {PREDS}, b AS (SELECT p.id, {sql_strip('p.pred')} AS t, lower({sql_strip('p.pred')}) AS l, {sql_strip('s.question')} AS o, lower({sql_strip('s.question')}) AS q FROM preds p JOIN samples s USING (id)), "
    f"k AS (SELECT *, {SQL_KIND} AS kind FROM b) SELECT id, CASE WHEN t = '' THEN 'empty' ELSE concat_ws(';', CASE WHEN length(t) < 24 THEN 'short_answer' END, CASE WHEN {_markers('l', T.UNCERTAIN)} THEN 'uncertainty_marker' END, "
    f"CASE WHEN {_CUT} THEN 'truncated_tail' END, CASE WHEN kind = 'paragraph_id' AND NOT regexp_matches(t, '(?i)\\bparagraph\\s*[0-9]+\\b') AND NOT regexp_matches(t, '第\\s*[0-9]+\\s*段') THEN 'paragraph_id_missing' END, "
    "CASE WHEN kind = 'entity_short' AND length(t) > 220 THEN 'entity_too_long' END, CASE WHEN kind = 'count' AND NOT regexp_matches(t, '[0-9]') THEN 'count_missing_number' END, "
    "CASE WHEN (starts_with(q, 'how many') OR starts_with(o, '多少')) AND NOT regexp_matches(t, '[0-9]') THEN 'count_missing_number' END) END AS reasons FROM k"
)
def low_confidence(spark, d):
    own = preds(spark, d).select("id", "pred").join(samples(spark, d).select("id", "question"), "id")
    return own.select("id", T.low_confidence(F.col("pred"), F.col("question"), T.answer_kind(F.col("question"))).alias("reasons"))


_GENERIC = ["what happened", "how many", "哪一年"]
_GENERIC_SQL = " ".join(f"WHEN contains(q, '{p}') THEN '{p}'" for p in _GENERIC)


@query(f"WITH {SAMPLES}, t AS (SELECT id, lower({sql_strip('question')}) AS q FROM samples) SELECT id, CASE {_GENERIC_SQL} ELSE '' END AS pattern FROM t")
def generic_question(spark, d):
    return samples(spark, d).select("id", names.generic_pattern(F.col("question"), _GENERIC).alias("pattern"))


_ONE = "SELECT DISTINCT id, output FROM student_train"
_STRIPPED = f"t AS (SELECT id, {sql_strip('output')} AS t FROM ({_ONE}))"


@query(
    f"WITH {_STRIPPED}, f AS (SELECT id, regexp_matches(t, '(?is)^<final>.*</final>$') AS a, regexp_matches(t, '(?is)^<search>.*</search>$') AS b, regexp_extract(t, '(?is)^<final>(.*?)</final>$', 1) AS x, regexp_extract(t, '(?is)^<search>(.*?)</search>$', 1) AS y FROM t) "
    f"SELECT id, CASE WHEN a <> b THEN CASE WHEN a THEN 'final' ELSE 'search' END END AS tag, CASE WHEN a <> b THEN {sql_strip('CASE WHEN a THEN x ELSE y END')} END AS content FROM f"
)
def protocol_parse(spark, d):
    tag, content = T.strict_tag(F.col("output"))
    return table(spark, d, "student_train").select("id", "output").distinct().select("id", tag.alias("tag"), content.alias("content"))


@query(
    f"WITH {_STRIPPED}, f AS (SELECT id, t, regexp_extract(t, '(?is)<\\s*final\\s*>(.*?)<\\s*/\\s*final\\s*>', 1) AS wf, regexp_extract(t, '(?is)<\\s*search\\s*>(.*?)<\\s*/\\s*search\\s*>', 1) AS ws, "
    "regexp_matches(t, '(?is)<\\s*final\\s*>(.*?)<\\s*/\\s*final\\s*>') AS hf, regexp_matches(t, '(?is)<\\s*search\\s*>(.*?)<\\s*/\\s*search\\s*>') AS hs, "
    f"{sql_strip('''regexp_extract(t, '(?is)^.*?<final>(.*)$', 1)''')} AS of, {sql_strip('''regexp_extract(t, '(?is)^.*?<search>(.*)$', 1)''')} AS os, "
    f"{sql_strip('''regexp_replace(''' + sql_strip('''regexp_extract(t, '(?is)^.*?final>(.*)$', 1)''') + ''', '(?is)</final>.*$', '')''')} AS mf, {sql_strip('''regexp_replace(''' + sql_strip('''regexp_extract(t, '(?is)^.*?search>(.*)$', 1)''') + ''', '(?is)</search>.*$', '')''')} AS ms FROM t) "
    f"SELECT id, CASE WHEN hf THEN 'final' WHEN hs THEN 'search' WHEN of <> '' THEN 'final' WHEN os <> '' THEN 'search' WHEN mf <> '' THEN 'final' WHEN ms <> '' THEN 'search' END AS tag, "
    f"CASE WHEN hf THEN {sql_strip('wf')} WHEN hs THEN {sql_strip('ws')} WHEN of <> '' THEN of WHEN os <> '' THEN os WHEN mf <> '' THEN mf WHEN ms <> '' THEN ms END AS content FROM f"
)
def protocol_relaxed(spark, d):
    tag, content = T.relaxed_tag(F.col("output"))
    return table(spark, d, "student_train").select("id", "output").distinct().select("id", tag.alias("tag"), content.alias("content"))


@query(f"WITH {CHUNKS} SELECT chunk_id, replace(replace(replace(coalesce(text, ''), 'ignore previous', ''), 'system prompt', ''), 'you are now', '') AS clean FROM chunks")
def strip_injection(spark, d):
    return chunks(spark, d).select("chunk_id", T.strip_phrases(F.col("text")).alias("clean"))


@query(f"WITH {CHUNKS}, r AS (SELECT sample_id, chunk_id, '[' || coalesce(doc_id, '') || '#' || chunk_id || '] ' || {sql_strip('text')} AS line FROM chunks) SELECT sample_id, string_agg(line, chr(10) ORDER BY chunk_id, line) AS evidence FROM r GROUP BY sample_id")
def format_evidence(spark, d):
    """All chunks of a sample."""
    from ..operators.memory import formatted_evidence

    return formatted_evidence(chunks(spark, d))


@query(
    f"WITH {CHUNKS}, r AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY chunk_id) - 1 AS pos FROM chunks), k AS (SELECT * FROM r WHERE {sql_strip('text')} <> ''), "
    f"o AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY pos) AS m FROM k) SELECT sample_id, sample_id || '_f' || pos AS fact_id, 'summary' AS type, substring({sql_strip('text')}, 1, 80) AS content, doc_id, chunk_id, "
    "least(1.0, greatest(0.0, coalesce(offset_start / 1000.0, 0.5)))::DOUBLE AS confidence FROM o WHERE m <= 3"
)
def fact_extract(spark, d):
    from ..operators.memory import facts

    hits = chunks(spark, d).withColumn("score", F.col("offset_start") / F.lit(1000.0))
    return facts(hits, limit=3)


@query(
    f"WITH {SAMPLES}, c AS (SELECT id, question, coalesce(array_to_string(list_transform(documents, lambda e: coalesce(e.text, '')), chr(10)), '') AS text FROM samples), "
    "p AS (SELECT id, question, unnest(regexp_split_to_array(text, '[\\n。！？!?]')) AS raw, unnest(range(1, len(regexp_split_to_array(text, '[\\n。！？!?]')) + 1)) AS i FROM c), "
    f"x AS (SELECT id, i, {sql_strip('raw')} AS s, list_filter({sql_query_tokens('question')}, lambda x: x NOT IN ({STOP})) AS k FROM p), "
    "r AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY len(list_filter(k, lambda t: contains(lower(s), t))) DESC, i) AS n FROM x WHERE s <> '') "
    "SELECT c.id, coalesce(r.s, substring(c.text, 1, 160)) AS sentence FROM c LEFT JOIN r ON r.id = c.id AND r.n = 1"
)
def best_sentence(spark, d):
    """Over all documents of a sample, in order."""
    return samples(spark, d).select("id", T.best_sentence(F.col("question"), T.context(F.col("documents"))).alias("sentence"))


@query(f"WITH {SAMPLES} SELECT id, coalesce(list_sum(list_transform(documents, lambda e: length(coalesce(e.text, '')))), 0)::BIGINT AS context_chars, coalesce(len(documents), 0)::BIGINT AS n_docs FROM samples")
def context_chars(spark, d):
    total = F.aggregate("documents", F.lit(0).cast("long"), lambda a, e: a + F.length(F.coalesce(e["text"], F.lit(""))))
    return samples(spark, d).select("id", F.coalesce(total, F.lit(0)).cast("long").alias("context_chars"), F.greatest(F.lit(0), F.coalesce(F.size("documents"), F.lit(0))).cast("long").alias("n_docs"))


@query(f"WITH {SAMPLES} SELECT id, regexp_replace(regexp_replace(id, '^lb_', ''), '_[^_]*$', '') AS dataset, substring(sha1(coalesce(question, '')), 1, 16) AS q_hash, substring(replace(id, '_', '/'), 1, 24) AS short FROM samples")
def id_builders(spark, d):
    return samples(spark, d).select("id", names.dataset_of(F.col("id")).alias("dataset"), names.question_hash(F.col("question")).alias("q_hash"), names.short_name(F.col("id")).alias("short"))


@query(
    f"WITH {SAMPLES}, {PREDS}, b AS (SELECT p.id, {sql_strip('p.pred')} AS t, lower({sql_strip('s.question')}) AS q FROM preds p JOIN samples s USING (id)), k AS (SELECT id, t, {SQL_KIND} AS kind, regexp_extract(t, '(?s)^(.*?[.!?。！？])\\s+.', 1) AS f FROM b) "
    "SELECT id, kind, CASE WHEN kind = 'count' AND regexp_matches(t, '[0-9]') THEN regexp_extract(t, '([0-9]+)', 1) WHEN kind = 'paragraph_id' AND regexp_matches(t, '(?i)\\bparagraph\\s*[0-9]+\\b') THEN 'Paragraph ' || regexp_extract(t, '(?i)\\bparagraph\\s*([0-9]+)\\b', 1) "
    "WHEN kind = 'paragraph_id' AND regexp_matches(t, '第\\s*[0-9]+\\s*段') THEN 'Paragraph ' || regexp_extract(t, '第\\s*([0-9]+)\\s*段', 1) WHEN kind = 'entity_short' AND regexp_matches(t, '(?i)^(yes|no)\\b') THEN lower(regexp_extract(t, '(?i)^(yes|no)\\b', 1)) "
    "WHEN kind = 'entity_short' AND length(f) >= 3 THEN f ELSE t END AS answer FROM k"
)
def typed_answer(spark, d):
    own = preds(spark, d).select("id", "pred").join(samples(spark, d).select("id", T.answer_kind(F.col("question")).alias("kind")), "id")
    return own.select("id", "kind", T.typed_answer(F.col("pred"), F.col("kind")).alias("answer"))
