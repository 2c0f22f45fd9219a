"""Source shapes flattened to the sample schema, from the tables at hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query
from ..sources import adapters
from .base import DOCS, SAMPLES, docs, samples, sql_strip

_STRIP_TEXT = sql_strip("text")
_CONTEXT = f"c AS (SELECT s.id, meta['dataset'] AS dataset, meta['language'] AS lang, question, answer, coalesce((SELECT string_agg('Passage ' || (pos + 1) || ':' || chr(10) || coalesce(text, ''), chr(10) ORDER BY pos) FROM docs WHERE docs.id = s.id), '') AS context FROM samples s)"


def _contexts(spark, d):
    lines = F.transform("documents", lambda e, i: F.concat(F.lit("Passage "), i + 1, F.lit(":\n"), F.coalesce(e["text"], F.lit(""))))
    return samples(spark, d).select("id", F.col("meta")["dataset"].alias("dataset"), F.col("meta")["language"].alias("lang"), "question", "answer", F.coalesce(F.array_join(lines, "\n"), F.lit("")).alias("context"))


@query(
    f"WITH {SAMPLES}, {DOCS}, {_CONTEXT}, t AS (SELECT id, {sql_strip('context')} AS t FROM c), l AS (SELECT id, t, regexp_extract_all(t, '(?i)(?:^|\\n)(Passage\\s+\\d+\\s*:)', 1) AS l, regexp_split_to_array(t, '(?i)(?:^|\\n)Passage\\s+\\d+\\s*:')[2:] AS b FROM t), "
    f"u AS (SELECT id, unnest(l) AS label, unnest(b) AS body FROM l WHERE len(l) > 1), p AS (SELECT id, lower(replace(replace(label, ' ', '_'), ':', '')) AS doc_id, {sql_strip('body')} AS text FROM u WHERE {sql_strip('body')} <> '') "
    "SELECT * FROM p UNION ALL SELECT id, 'd1' AS doc_id, t AS text FROM t WHERE id NOT IN (SELECT id FROM p)"
)
def split_passages(spark, d):
    made = _contexts(spark, d).select("id", F.explode(adapters.split_passages(F.col("context"))).alias("e"))
    return made.select("id", "e.doc_id", "e.text")


@query(f"WITH {SAMPLES} SELECT id, coalesce(list_filter(list_transform([answer, ' ', question], lambda a: {sql_strip('a')}), lambda a: a <> '')[1], '') AS first_usable, {sql_strip('answer')} AS first_any FROM samples")
def first_nonblank_answer(spark, d):
    answers = F.array("answer", F.lit(" "), "question")
    return samples(spark, d).select("id", adapters.first_answer(answers).alias("first_usable"), adapters.first_answer(answers, True).alias("first_any"))


_NAME = "regexp_replace(coalesce(dataset, ''), '^lb_', '')"


@query(
    f"WITH {SAMPLES}, {DOCS}, {_CONTEXT} SELECT id, CASE WHEN lower({_NAME}) IN ('narrativeqa', 'qasper', 'multifieldqa_en', 'multifieldqa_zh') THEN 'single_doc_qa' WHEN lower({_NAME}) IN ('hotpotqa', '2wikimqa', 'musique', 'dureader') THEN 'multi_doc_qa' WHEN lower({_NAME}) IN ('lcc', 'repobench-p') THEN 'code_qa' ELSE 'single_doc_qa' END AS task_group, "
    f"CASE WHEN lower({_NAME}) IN ('lcc', 'repobench-p') OR lower(coalesce(lang, '')) IN ('python', 'java', 'cpp', 'javascript', 'go') THEN 'code_qa' WHEN lower({_NAME}) IN ('2wikimqa', 'hotpotqa', 'musique', 'multi_news', 'qmsum') THEN 'multi_doc_qa' WHEN regexp_matches(context, '(?i)Passage\\s+2\\s*:') THEN 'multi_doc_qa' ELSE 'single_doc_qa' END AS task_type FROM c"
)
def task_map(spark, d):
    name = F.regexp_replace(F.coalesce("dataset", F.lit("")), "^lb_", "")
    return _contexts(spark, d).select("id", adapters.task_group(name).alias("task_group"), adapters.task_type(name, F.col("lang"), F.col("context")).alias("task_type"))


@query(
    f"WITH {SAMPLES}, {DOCS}, k AS (SELECT id, coalesce(nullif({sql_strip('doc_id')}, ''), 'd' || (pos + 1)) AS doc_id, {_STRIP_TEXT} AS text FROM docs), f AS (SELECT * FROM k WHERE text <> ''), e AS (SELECT id, 'd1' AS doc_id, 'N/A' AS text FROM samples WHERE id NOT IN (SELECT id FROM f)), u AS (SELECT * FROM f UNION ALL SELECT * FROM e) "
    f"SELECT u.id, u.doc_id, u.text, coalesce(nullif({sql_strip('question')}, ''), 'Answer from the context.') AS question, coalesce(nullif({sql_strip('answer')}, ''), 'unknown') AS answer FROM u JOIN samples USING (id)"
)
def dataset_row(spark, d):
    made = adapters.normalized(samples(spark, d).select("id", "question", "answer", "documents"))
    return made.select("id", F.explode("documents").alias("e"), "question", "answer").select("id", "e.doc_id", "e.text", "question", "answer")


@query(f"WITH {SAMPLES}, {DOCS} SELECT 'hpqa_train_' || {sql_strip('d.id')} AS id, coalesce(nullif({sql_strip('doc_id')}, ''), 'doc' || (pos + 1)) AS doc_id, {_STRIP_TEXT} AS text FROM docs d WHERE {_STRIP_TEXT} <> ''")
def nested_flatten(spark, d):
    context = F.struct(F.transform("documents", lambda e: e["doc_id"]).alias("title"), F.transform("documents", lambda e: F.array(e["text"])).alias("sentences"))
    raw = samples(spark, d).select("id", "question", "answer", F.lit("bridge").alias("type"), F.lit("easy").alias("level"), context.alias("context"))
    made = adapters.titled_sentences(raw, "train").select("id", F.explode("documents").alias("e")).select("id", "e.doc_id", "e.text")
    return made.where("text <> 'N/A'")


_QUESTION = f"coalesce(nullif({sql_strip('question')}, ''), 'Answer from the context.')"
_ANSWER = f"coalesce(nullif({sql_strip('answer')}, ''), 'unknown')"
_TITLED = sql_strip(f"{sql_strip('doc_id')} || chr(10) || {_STRIP_TEXT}")


def _with_none(made: str) -> str:
    """The documents of each sample, or the one that stands for none."""
    return f"k AS ({made}), f AS (SELECT * FROM k WHERE text <> '' UNION ALL SELECT id, 'd1' AS doc_id, 'N/A' AS text FROM kept WHERE id NOT IN (SELECT id FROM k WHERE text <> ''))"


def _flat(made):
    return made.select("id", "task", F.explode("documents").alias("e"), "question", "answer").select("id", "task", "e.doc_id", "e.text", "question", "answer")


@query(
    f"WITH {SAMPLES}, {DOCS}, kept AS (SELECT * FROM samples), "
    + _with_none(f"SELECT s.id, s.id AS doc_id, coalesce(nullif({sql_strip('d.text')}, ''), {sql_strip('s.answer')}) AS text FROM samples s LEFT JOIN docs d ON d.id = s.id AND d.pos = 0")
    + f" SELECT 'nqa_train_' || kept.id || '_' || substring(sha1({sql_strip('question')}), 1, 16) AS id, 'single_doc_qa' AS task, doc_id, text, {_QUESTION} AS question, {_ANSWER} AS answer FROM f JOIN kept USING (id)"
)
def narrative_rows(spark, d):
    raw = samples(spark, d).select(F.struct("id", F.lit("book").alias("kind"), F.struct(F.col("answer").alias("text")).alias("summary")).alias("document"), F.struct(F.col("question").alias("text")).alias("question"), F.array(F.struct(F.col("answer").alias("text"))).alias("answers"))
    return _flat(adapters.narrative(raw, "train", docs(spark, d).where("pos = 0").select("id", "text")))


@query(
    f"WITH {SAMPLES}, {DOCS}, kept AS (SELECT * FROM samples WHERE {sql_strip('answer')} <> ''), "
    + _with_none(f"SELECT id, 'abstract' AS doc_id, {sql_strip('answer')} AS text FROM kept UNION ALL SELECT d.id, printf('sec_%02d', pos + 1), CASE WHEN {_STRIP_TEXT} = '' THEN '' ELSE {_TITLED} END FROM docs d JOIN kept USING (id)")
    + f" SELECT 'qasper_train_' || {sql_strip('kept.id')} || '_' || substring(kept.id, 1, 24) AS id, 'single_doc_qa' AS task, doc_id, text, {_QUESTION} AS question, {_ANSWER} AS answer FROM f JOIN kept USING (id)"
)
def paper_rows(spark, d):
    """Each sample as a paper; an annotation that can't be used comes before the one that can."""
    note = lambda skip, text: F.struct(F.lit(skip).alias("unanswerable"), F.array(F.lit(" ")).alias("extractive_spans"), text.alias("free_form_answer"), F.lit(None).cast("boolean").alias("yes_no"))
    asked = F.struct(F.array("question").alias("question"), F.array("id").alias("question_id"), F.array(F.array(note(True, F.lit("no")), note(False, F.col("answer")))).alias("answers"))
    text = F.struct(F.transform("documents", lambda e: e["doc_id"]).alias("section_name"), F.transform("documents", lambda e: F.array(e["text"])).alias("paragraphs"))
    own = samples(spark, d).withColumn("documents", F.coalesce("documents", F.array().cast("array<struct<doc_id:string,text:string>>")))
    return _flat(adapters.papers(own.select("id", F.lit("t").alias("title"), F.col("answer").alias("abstract"), text.alias("full_text"), asked.alias("qas")), "train"))


@query(
    f"WITH {SAMPLES}, {DOCS}, kept AS (SELECT * FROM samples), "
    + _with_none(f"SELECT id, coalesce(nullif({sql_strip('doc_id')}, ''), 'para' || (pos + 1)) AS doc_id, CASE WHEN {_STRIP_TEXT} = '' THEN '' ELSE {_TITLED} END AS text FROM docs")
    + f" SELECT 'musique_valid_' || {sql_strip('kept.id')} AS id, 'multi_doc_qa' AS task, doc_id, text, {_QUESTION} AS question, {_ANSWER} AS answer FROM f JOIN kept USING (id)"
)
def paragraph_rows(spark, d):
    raw = samples(spark, d).select("id", "question", "answer", F.transform("documents", lambda e: F.struct(e["doc_id"].alias("title"), e["text"].alias("paragraph_text"))).alias("paragraphs"))
    return _flat(adapters.paragraphs(raw, "valid"))


_REPO = sql_strip("meta['dataset']")


@query(
    f"WITH {SAMPLES}, {DOCS}, r AS (SELECT id, {_REPO} AS repo, {sql_strip('id')} AS file, {sql_strip('task')} AS imports, {sql_strip('question')} AS code, answer FROM samples), "
    "k AS (SELECT id, 'target_prefix' AS doc_id, 'Repository: ' || repo || chr(10) || 'Target file: ' || file || chr(10) || 'Imports:' || chr(10) || imports || chr(10) || 'Current code prefix:' || chr(10) || code AS text FROM r "
    f"UNION ALL SELECT id, printf('ctx_%02d', pos + 1), 'Path: ' || {sql_strip('doc_id')} || chr(10) || 'Identifier: ' || chr(10) || 'Snippet:' || chr(10) || {_STRIP_TEXT} FROM docs) "
    "SELECT 'repobench_python_' || substring(replace(repo, '/', '_'), 1, 24) || '_' || substring(md5(repo || '|' || file || '|' || code), 1, 12) AS id, 'code_qa' AS task, doc_id, "
    f"{sql_strip('text')} AS text, 'What is the next line of code in `' || file || '`?' AS question, {_ANSWER} AS answer FROM k JOIN r USING (id)"
)
def repository_rows(spark, d):
    snippets = F.transform("documents", lambda e: F.struct(e["doc_id"].alias("path"), F.lit("").alias("identifier"), e["text"].alias("snippet")))
    raw = samples(spark, d).select(F.col("meta")["dataset"].alias("repo_name"), F.col("id").alias("file_path"), F.col("task").alias("import_statement"), F.col("question").alias("cropped_code"), F.col("answer").alias("next_line"), F.lit("easy").alias("level"), snippets.alias("context"))
    return _flat(adapters.repositories(raw, "python"))


@query(
    f"WITH {SAMPLES}, {DOCS}, {_CONTEXT} SELECT 'mlb_hotpotqa_' || substring({sql_strip('id')}, 1, 24) AS id, CASE WHEN lower(coalesce(lang, '')) IN ('python', 'java', 'cpp', 'javascript', 'go') THEN 'code_qa' ELSE 'multi_doc_qa' END AS task, {_QUESTION} AS question, {_ANSWER} AS answer FROM c"
)
def long_context_rows(spark, d):
    own = _contexts(spark, d).select(F.col("id").alias("_id"), F.col("question").alias("input"), "context", F.array("answer").alias("answers"), F.col("lang").alias("language"), F.length("context").alias("length"))
    return adapters.long_context(own, "hotpotqa").select("id", "task", "question", "answer")
