"""The loop, the baseline, policy and answer clean-up.

The loop with a model that searches and answers by turns has no SQL; the same loop with a
model that always answers and with one that always searches has.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as T
from ..operators import agent
from ..operators import policy as P
from ..plans import runs
from ..registry import query
from .base import CHUNKS, PREDS, SAMPLES, W, chunks, preds, samples, sql_query_tokens, sql_strip
from .retrieval import LEXICAL, QUERIES
from .text import SQL_KIND, STOP

#: A whole configuration, so that every branch of the policy is used.
LIMITS = P.Limits(
    top_k=2, top_k_iter=1, max_steps=3, max_tokens=224, temperature=0.25, prompt_tokens=7000, facts=5,
    tasks={
        P.SINGLE: P.TaskRules(top_k=3, max_steps=4, max_tokens=200, token_cap=160, doubt=P.Doubt(True, 20), forced=P.Forced(True)),
        P.MULTI: P.TaskRules(top_k=4, top_k_iter=2, max_steps=5, temperature=0.2, token_cap=176, compact="aggressive", rewrite=True, doubt=P.Doubt(True, 20), forced=P.Forced(True)),
        "code_qa": P.TaskRules(top_k=2, temperature=0.15, max_tokens=160, token_cap=160, doubt=P.Doubt(True, 16), forced=P.Forced(True)),
    },
    fast=P.FastPath(kinds=["count", "paragraph_id"]), generic=P.Generic(True, ["what happened", "according to the context"]), long=P.LongContext(True, 20_000, forced=False, refine=False),
    stop=P.EarlyStop(shortcut=True), caps=P.TokenCaps(True, 190, 12, 128), refine=P.Refine(True), compact=P.Compact(True, 100, entity=True, code=True),
)


@query()
def agent_loop_mock(spark, d):
    done = agent.run(samples(spark, d), chunks(spark, d), limits=LIMITS)
    return done.select("id", "pred", "n_steps", "n_retrieval", "chunks_total", "prompt_tokens", "completion_tokens", "error_count", "stop_reason")


@query()
def agent_trace(spark, d):
    return agent.trace(agent.run(samples(spark, d), chunks(spark, d), limits=LIMITS))


def _always_answers(question, evidence, step, max_steps, repair):
    return f"<final>{(evidence.splitlines() or [''])[0][:60]}</final>"


def _always_searches(question, evidence, step, max_steps, repair):
    return f"<search>{question}</search>"


_OWN = "own AS (SELECT sample_id AS id, count(*) AS n FROM chunks GROUP BY sample_id)"
_OPEN = P.Limits(top_k=2, single_top_k=2, max_steps=4, fast=P.FastPath(kinds=[]), stop=P.EarlyStop(rewrite=False))


@query(
    f"WITH {SAMPLES}, {CHUNKS}, {_OWN} "
    "SELECT s.id, 1 AS n_steps, (own.n IS NOT NULL)::INT AS n_retrieval, least(coalesce(own.n, 0), 2)::INT AS chunks_total, 0 AS error_count, 'final' AS stop_reason, 'final' AS last_tag FROM samples s LEFT JOIN own USING (id)"
)
def agent_always_answers(spark, d):
    done = agent.run(samples(spark, d), chunks(spark, d), _always_answers, _OPEN)
    return done.join(agent.roll_up(done).select("id", "last_tag"), "id").select("id", "n_steps", "n_retrieval", "chunks_total", "error_count", "stop_reason", "last_tag")


@query(
    f"WITH {SAMPLES}, {CHUNKS}, {_OWN} SELECT s.id, 2 AS n_steps, (2 + (own.n IS NOT NULL)::INT)::INT AS n_retrieval, (least(coalesce(own.n, 0), 2) + 2 * least(coalesce(own.n, 0), 1))::INT AS chunks_total, 0 AS error_count, "
    f"'same_keyword_hits>=2;no_new_chunk_steps>=2' AS stop_reason, [trim(regexp_replace(lower({sql_strip('question')}), '{W}+', ' ', 'g'))] AS keywords FROM samples s LEFT JOIN own USING (id) WHERE {sql_strip('question')} <> ''"
)
def agent_always_searches(spark, d):
    own = samples(spark, d).where(T.safe_text(F.col("question")) != "")
    done = agent.run(own, chunks(spark, d), _always_searches, _OPEN)
    return done.join(agent.roll_up(done).select("id", F.col("keywords").alias("distinct")), "id").select("id", "n_steps", "n_retrieval", "chunks_total", "error_count", "stop_reason", F.col("distinct").alias("keywords"))


_TOP = (
    "allp AS (SELECT q.qid, c.chunk_id, c.text, coalesce(lex.score, 0.0) AS score FROM queries q JOIN chunks c USING (sample_id) LEFT JOIN lex ON lex.qid = q.qid AND lex.chunk_id = c.chunk_id), "
    "top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_id) AS r FROM allp))"
)


@query(
    f"WITH {SAMPLES}, {CHUNKS}, {QUERIES}, {LEXICAL}, {_TOP}, c AS (SELECT qid AS id, string_agg({sql_strip('text')}, chr(10) ORDER BY r) AS context, count(*) AS n FROM top WHERE r <= 2 GROUP BY qid), "
    f"k AS (SELECT s.id, context, n, list_filter({sql_query_tokens('question')}, lambda x: x NOT IN ({STOP})) AS keys FROM samples s JOIN c USING (id)), "
    "e AS (SELECT * FROM k WHERE length(context) >= 24 AND len(list_filter(keys, lambda t: contains(lower(context), t))) >= 2), "
    "p AS (SELECT id, keys, unnest(regexp_split_to_array(context, '[\\n。！？!?]')) AS raw, unnest(range(1, len(regexp_split_to_array(context, '[\\n。！？!?]')) + 1)) AS i FROM e), "
    f"x AS (SELECT id, i, keys, {sql_strip('raw')} AS s FROM p), b AS (SELECT id, arg_min(s, (-len(list_filter(keys, lambda t: contains(lower(s), t)))) * 1000000 + i) AS answer FROM x WHERE s <> '' GROUP BY id) "
    "SELECT id, answer, 1 AS n_retrieval, n::INT AS chunks_total, 0 AS error_count, 'final' AS stop_reason FROM b JOIN e USING (id)"
)
def agent_first_step(spark, d):
    """The runs of the deterministic model that end with their first step."""
    done = agent.run(samples(spark, d), chunks(spark, d), limits=_OPEN).where("n_steps = 1")
    return done.select("id", F.col("raw").alias("answer"), "n_retrieval", "chunks_total", "error_count", "stop_reason")


_PROMPT = "'你是一个严谨的问答助手。请只根据 Context 回答 Question，答案要简洁。' || chr(10) || 'Question: ' || coalesce(question, '') || chr(10) || 'Context:' || chr(10) || context || chr(10) || '请输出最终答案，不要输出推理过程。'"


@query(
    f"WITH {SAMPLES}, {CHUNKS}, {QUERIES}, {LEXICAL}, {_TOP}, "
    f"c AS (SELECT qid AS id, string_agg({sql_strip('text')}, chr(10) ORDER BY r) AS context, count(*) AS n FROM top WHERE r <= 3 GROUP BY qid), "
    "j AS (SELECT s.id, s.question, coalesce(c.context, '') AS context, coalesce(c.n, 0) AS n FROM samples s LEFT JOIN c USING (id)), "
    "p AS (SELECT id, question, unnest(regexp_split_to_array(context, '[\\n。！？!?]')) AS raw, unnest(range(1, len(regexp_split_to_array(context, '[\\n。！？!?]')) + 1)) AS i FROM j), "
    f"x AS (SELECT id, i, {sql_strip('raw')} AS s, list_filter({sql_query_tokens('question')}, lambda x: x NOT IN ({STOP})) AS k FROM p), "
    "b AS (SELECT id, s, row_number() OVER (PARTITION BY id ORDER BY len(list_filter(k, lambda t: contains(lower(s), t))) DESC, i) AS m FROM x WHERE s <> ''), "
    f"y AS (SELECT j.id, coalesce(b.s, substring(j.context, 1, 160)) AS pred, {_PROMPT} AS prompt, n FROM j LEFT JOIN b ON b.id = j.id AND b.m = 1) "
    f"SELECT id, {sql_strip('pred')} AS pred, 1 AS n_steps, (n > 0)::INT AS n_retrieval, 0 AS error_count, 'mock' AS backend_mode, greatest(1, length(prompt) // 2)::BIGINT AS prompt_tokens_total, greatest(1, length(pred) // 2)::BIGINT AS completion_tokens_total, n::BIGINT AS retrieved_chunks_total FROM y"
)
def baseline_rag_run(spark, d):
    return runs.baseline(samples(spark, d), chunks(spark, d))


def _q(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _sql_without(c: str, ends: str) -> str:
    return f"regexp_replace({c}, '^[{ends}]+|[{ends}]+$', '', 'g')"


def _sql_spaced(c: str) -> str:
    return sql_strip(f"regexp_replace({c}, '{W}+', ' ', 'g')")


def _sql_cut(c: str, most: int) -> str:
    return f"CASE WHEN length({c}) > {most} THEN regexp_replace(substring({c}, 1, {most}), '[ ,;]+$', '') ELSE {c} END"


_FIRST = _q(answers.FIRST_SENTENCE)
_SPAN = "coalesce(" + ", ".join(
    f"CASE WHEN {'starts_with' if begins else 'contains'}(q, '{word}') THEN nullif({_sql_without(f'''regexp_extract(src, {_q('(?i)' + pattern)}, 1)''', ' .,:;')}, '') END" for word, begins, pattern in answers.SPANS
) + ", CASE WHEN length(first) >= 4 THEN first ELSE src END)"


@query(
    f"WITH {SAMPLES}, {PREDS}, o AS (SELECT p.id, coalesce(s.task, '') AS task, {sql_strip('p.pred')} AS src, lower({sql_strip('s.question')}) AS q, coalesce(p.pred, '') AS raw FROM preds p JOIN samples s USING (id)), "
    # prose
    f"a AS (SELECT *, regexp_replace({sql_strip(f'regexp_replace(src, {_q(answers.opening_pattern(answers.PROSE_WORDS, answers.PROSE_LABELS))}, {_q(str())})')}, {_q(answers.loose_end_pattern(answers.LOOSE_ENDS))}, '') AS ended FROM o), "
    f"b AS (SELECT *, regexp_extract(ended, {_FIRST}, 1) AS f, {sql_strip(f'regexp_extract(src, {_FIRST}, 1)')} AS first FROM a), "
    f"p AS (SELECT *, {_sql_spaced(f'''CASE WHEN (length(ended) > 220 OR contains(lower(src), 'wait')) AND length(f) >= 8 THEN f ELSE ended END''')} AS prose FROM b), "
    # short
    f"s2 AS (SELECT *, {_sql_without(_sql_spaced(f'''regexp_replace({_SPAN}, '[*_`]+', '', 'g')'''), ' ,;')} AS short FROM p), "
    # code
    f"c1 AS (SELECT *, {sql_strip('''regexp_replace(replace(replace(raw, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '```[\\w+-]*', '', 'g')''')} AS bare FROM s2), "
    f"c2 AS (SELECT *, {sql_strip(f'''regexp_replace(coalesce(list_filter(list_transform(regexp_extract_all(bare, '`([^`' || chr(10) || ']+)`', 1), lambda x: {sql_strip('x')}), lambda x: x <> '')[1], bare), {_q(answers.opening_pattern(answers.CODE_WORDS, answers.CODE_LABELS))}, '')''')} AS begun FROM c1), "
    f"c3 AS (SELECT *, list_filter(list_transform(string_split(begun, chr(10)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS lines FROM c2), "
    f"c4 AS (SELECT *, {_sql_without(_sql_spaced(_sql_without(f'''coalesce(list_filter(lines, lambda x: regexp_matches(x, {_q(answers.code_line_pattern(answers.CODE_STARTS))}))[1], lines[1], '')''', ' `')), ' ,;')} AS code FROM c3) "
    f"SELECT id, CASE task WHEN 'code_qa' THEN {_sql_cut('code', 160)} WHEN 'multi_doc_qa' THEN {_sql_cut('short', 96)} ELSE prose END AS answer FROM c4"
)
def clean_answers(spark, d):
    own = preds(spark, d).join(samples(spark, d).select("id", "task", "question"), "id")
    return own.select("id", answers.cleaned(F.coalesce("task", F.lit("")), F.col("pred"), F.col("question")).alias("answer"))


_CHARS = "coalesce(list_sum(list_transform(documents, lambda e: length(coalesce(e.text, '')))), 0)"


@query(
    f"WITH {SAMPLES}, b AS (SELECT id, task, question, {_CHARS} AS chars, lower({sql_strip('question')}) AS q, len({sql_query_tokens('question')}) AS nt, coalesce(task = 'single_doc_qa', false) AS single FROM samples), "
    f"k AS (SELECT *, CASE WHEN single THEN CASE WHEN contains(lower(id), 'passage_count') THEN 'count' WHEN contains(lower(id), 'passage_retrieval') THEN 'paragraph_id' ELSE {SQL_KIND} END ELSE 'open_text' END AS kind FROM b), "
    "f AS (SELECT *, single AND kind IN ('count', 'paragraph_id') AS fast, single AND (contains(q, 'what happened') OR contains(q, 'according to the context')) AS generic, single AND chars >= 20000 AS long FROM k), "
    "s1 AS (SELECT *, CASE WHEN single THEN 4 WHEN task = 'multi_doc_qa' THEN 5 ELSE 3 END AS s0 FROM f), s2 AS (SELECT *, CASE WHEN fast THEN least(s0, 2) ELSE s0 END AS sa FROM s1), s3 AS (SELECT *, CASE WHEN generic THEN least(sa, 2) ELSE sa END AS sb FROM s2), "
    "t1 AS (SELECT *, least(CASE WHEN single THEN 200 WHEN task = 'code_qa' THEN 160 ELSE 224 END, 190, CASE WHEN single THEN 160 WHEN task = 'multi_doc_qa' THEN 176 WHEN task = 'code_qa' THEN 160 ELSE 999 END) AS t0 FROM s3) "
    "SELECT id, kind, fast, generic, long, CASE WHEN long THEN 4 WHEN single THEN 3 WHEN task = 'multi_doc_qa' THEN 4 ELSE 2 END AS top_k, CASE WHEN task = 'multi_doc_qa' THEN 2 ELSE 1 END AS top_k_iter, CASE WHEN long THEN greatest(sb, 4) ELSE sb END AS max_steps, "
    "CASE WHEN task = 'multi_doc_qa' THEN 0.2 WHEN task = 'code_qa' THEN 0.15 ELSE 0.25 END::DOUBLE AS temperature, CASE WHEN nt <= 12 THEN least(t0, 128) ELSE t0 END AS max_tokens, NOT long AS shortcut, single AND NOT fast AND NOT generic AND NOT long AS refine, "
    "coalesce(task IN ('single_doc_qa', 'multi_doc_qa', 'code_qa'), false) AND NOT generic AND NOT long AS forced FROM t1"
)
def agent_policy(spark, d):
    size = F.aggregate("documents", F.lit(0).cast("long"), lambda a, e: a + F.length(F.coalesce(e["text"], F.lit(""))))
    own = samples(spark, d).select("id", "task", "question", F.coalesce(size, F.lit(0)).alias("context_chars"))
    return P.policy(own, LIMITS).select("id", *P.COLUMNS)
