"""Nested question-answering sources as one schema: id, task, question, documents, answer, meta.

Every adapter is a projection over one row of its source, so it runs where the source is
read; only two-level sources explode.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

#: Task groups by dataset, and what else names a task.
GROUPS = {
    "single_doc_qa": ["narrativeqa", "qasper", "multifieldqa_en", "multifieldqa_zh"],
    "multi_doc_qa": ["hotpotqa", "2wikimqa", "musique", "dureader"],
    "code_qa": ["lcc", "repobench-p"],
}
MULTI_TASKS = ["2wikimqa", "hotpotqa", "musique", "multi_news", "qmsum"]
CODE_LANGUAGES = ["python", "java", "cpp", "javascript", "go"]
NO_QUESTION, NO_ANSWER, NO_DOCUMENT = "Answer from the context.", "unknown", "N/A"


def _record(**fields: Column) -> Column:
    """A struct whose field names hold within nested lambda functions too."""
    return F.named_struct(*(x for name, value in fields.items() for x in (F.lit(name), value)))


def task_group(dataset: Column) -> Column:
    out = F.when(F.lit(False), "")
    for group, names in GROUPS.items():
        out = out.when(F.lower(T.safe_text(dataset)).isin(names), group)
    return out.otherwise("single_doc_qa")


def task_type(source_task: Column, lang: Column, context: Column) -> Column:
    """By task name or programming language, then by a second passage in the context."""
    task, lang = F.lower(F.coalesce(source_task, F.lit(""))), F.lower(F.coalesce(lang, F.lit("")))
    return (
        F.when(task.isin(GROUPS["code_qa"]) | lang.isin(CODE_LANGUAGES), "code_qa").when(task.isin(MULTI_TASKS), "multi_doc_qa")
        .when(F.coalesce(context, F.lit("")).rlike(r"(?i)Passage\s+2\s*:"), "multi_doc_qa").otherwise("single_doc_qa")
    )


def split_passages(context: Column) -> Column:
    """Documents of a context with markers 'Passage n:' at line starts.

    Text before the first marker and blank passages are dropped. Fewer than two markers, or
    no text at all, give one document d1.
    """
    text = T.safe_text(context)
    marker = r"(?i)(?:^|\n)Passage\s+\d+\s*:"
    labels = F.regexp_extract_all(text, F.lit(r"(?i)(?:^|\n)(Passage\s+\d+\s*:)"), F.lit(1))
    bodies = F.transform(F.slice(F.split(text, marker), 2, 1_000_000), T.strip)
    label = lambda s: F.lower(F.replace(F.regexp_replace(s, " ", "_"), F.lit(":"), F.lit("")))
    docs = F.filter(F.transform(F.arrays_zip(labels.alias("l"), bodies.alias("b")), lambda z: _record(doc_id=label(z["l"]), text=z["b"])), lambda e: e["text"] != "")
    whole = F.array(_record(doc_id=F.lit("d1"), text=text))
    return F.when((F.size(labels) > 1) & (F.size(docs) > 0), docs).otherwise(whole)


def first_answer(answers: Column, blank_counts: bool = False) -> Column:
    """The first answer with text; with ``blank_counts`` the first whatever it is. Empty if there is none."""
    cleaned = F.transform(answers, T.safe_text)
    kept = cleaned if blank_counts else F.filter(cleaned, lambda a: a != "")
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def normalized(df: DataFrame) -> DataFrame:
    """Rows of id, task, question, documents, answer and meta with blanks replaced and blank documents dropped.

    A document without an id is named by its place among all.
    """
    named = F.transform("documents", lambda e, i: _record(doc_id=F.coalesce(F.nullif(T.safe_text(e["doc_id"]), F.lit("")), F.concat(F.lit("d"), i + 1)), text=T.safe_text(e["text"])))
    kept = F.filter(F.coalesce(named, F.array().cast("array<struct<doc_id:string,text:string>>")), lambda e: e["text"] != "")
    empty = F.array(_record(doc_id=F.lit("d1"), text=F.lit(NO_DOCUMENT)))
    filled = lambda c, default: F.coalesce(F.nullif(T.safe_text(F.col(c)), F.lit("")), F.lit(default))
    return df.withColumns({"question": filled("question", NO_QUESTION), "answer": filled("answer", NO_ANSWER), "documents": F.when(F.size(kept) > 0, kept).otherwise(empty)})


def joined_lines(lines: Column) -> Column:
    return F.array_join(F.filter(F.transform(lines, T.safe_text), lambda s: s != ""), "\n")


def long_context(df: DataFrame, source_task: str) -> DataFrame:
    """Rows of _id, input, context, answers, language, length."""
    # a row without an id is named by its content, alike in every run
    name = F.coalesce(F.nullif(T.safe_text(F.col("_id")), F.lit("")), F.md5(F.concat_ws("|", "input", "context")))
    meta = F.create_map(F.lit("source_task"), F.lit(source_task), F.lit("language"), T.safe_text(F.col("language")), F.lit("length"), F.col("length").cast("string"))
    return normalized(df.select(F.concat(F.lit(f"mlb_{source_task}_"), F.substring(name, 1, 24)).alias("id"), task_type(F.lit(source_task), F.col("language"), F.col("context")).alias("task"), F.col("input").alias("question"), split_passages(F.col("context")).alias("documents"), first_answer(F.col("answers"), True).alias("answer"), meta.alias("meta")))


def narrative(df: DataFrame, split: str, full_text: DataFrame | None = None) -> DataFrame:
    """Rows of document, question, answers (structs); the text is the full text by id, else the summary."""
    doc = T.safe_text(F.col("document.id"))
    df = df.withColumn("_doc", doc)
    if full_text is not None:
        df = df.join(full_text.select(F.col("id").alias("_doc"), F.col("text").alias("_full")), "_doc", "left")
    else:
        df = df.withColumn("_full", F.lit(None).cast("string"))
    text = F.coalesce(F.nullif(T.safe_text(F.col("_full")), F.lit("")), T.safe_text(F.col("document.summary.text")))
    question = T.safe_text(F.col("question.text"))
    named = F.coalesce(F.nullif(F.col("_doc"), F.lit("")), F.lit("doc"))
    row = F.concat_ws("_", F.lit("nqa"), F.lit(split), named, F.substring(F.sha1(question), 1, 16))
    docs = F.array(_record(doc_id=F.coalesce(F.nullif(F.col("_doc"), F.lit("")), F.lit("d1")), text=text))
    meta = F.create_map(F.lit("source_task"), F.lit("narrativeqa"), F.lit("kind"), T.safe_text(F.col("document.kind")), F.lit("uses_full_text"), F.col("_full").isNotNull().cast("string"))
    return normalized(df.select(row.alias("id"), F.lit("single_doc_qa").alias("task"), question.alias("question"), docs.alias("documents"), first_answer(F.transform("answers", lambda a: a["text"])).alias("answer"), meta.alias("meta")))


def paper_answer(answers: Column) -> Column:
    """The first usable annotation: free text, else the first span, else yes or no; unanswerable ones are skipped."""
    def one(a: Column) -> Column:
        span = F.get(F.filter(F.transform(a["extractive_spans"], T.safe_text), lambda s: s != ""), F.lit(0))
        return F.coalesce(F.nullif(T.safe_text(a["free_form_answer"]), F.lit("")), span, F.when(a["yes_no"], "Yes").when(~a["yes_no"], "No"))

    usable = F.transform(F.filter(answers, lambda a: ~F.coalesce(a["unanswerable"], F.lit(False))), one)
    return F.coalesce(F.get(F.filter(usable, lambda x: x.isNotNull()), F.lit(0)), F.lit(""))


def papers(df: DataFrame, split: str) -> DataFrame:
    """Rows of id, title, abstract, full_text (section_name[], paragraphs[][]) and qas (question[], question_id[], answers[][]).

    One row per question with a usable answer; its documents are the abstract and the sections with text.
    """
    sections = F.transform(F.arrays_zip(F.col("full_text.section_name").alias("n"), F.col("full_text.paragraphs").alias("p")), lambda z, i: F.named_struct(F.lit("doc_id"), F.format_string("sec_%02d", i + 1), F.lit("b"), joined_lines(z["p"]), F.lit("n"), T.safe_text(z["n"])))
    kept = F.transform(F.filter(sections, lambda s: s["b"] != ""), lambda s: _record(doc_id=s["doc_id"], text=T.strip(F.concat(s["n"], F.lit("\n"), s["b"]))))
    head = F.filter(F.array(_record(doc_id=F.lit("abstract"), text=T.safe_text(F.col("abstract")))), lambda e: e["text"] != "")
    asked = F.posexplode(F.arrays_zip(F.col("qas.question").alias("q"), F.col("qas.question_id").alias("i"), F.col("qas.answers").alias("a"))).alias("at", "z")
    rows = df.select("id", "title", F.concat(head, kept).alias("documents"), asked).withColumn("answer", paper_answer(F.col("z.a"))).where("answer <> ''")
    name = F.concat_ws("_", F.lit("qasper"), F.lit(split), T.safe_text(F.col("id")), F.substring(F.coalesce("z.i", F.col("at").cast("string")), 1, 24))
    return normalized(rows.select(name.alias("id"), F.lit("single_doc_qa").alias("task"), F.col("z.q").alias("question"), "documents", "answer", F.create_map(F.lit("source_task"), F.lit("qasper"), F.lit("paper_title"), T.safe_text(F.col("title"))).alias("meta")))


def titled_sentences(df: DataFrame, split: str) -> DataFrame:
    """Rows of id, question, answer, type, level and context (title[], sentences[][])."""
    zipped = F.transform(F.arrays_zip(F.col("context.title").alias("t"), F.col("context.sentences").alias("s")), lambda z, i: _record(doc_id=F.coalesce(F.nullif(T.safe_text(z["t"]), F.lit("")), F.concat(F.lit("doc"), i + 1)), text=joined_lines(z["s"])))
    meta = F.create_map(F.lit("source_task"), F.lit("hotpotqa"), F.lit("type"), T.safe_text(F.col("type")), F.lit("level"), T.safe_text(F.col("level")))
    return normalized(df.select(F.concat(F.lit(f"hpqa_{split}_"), T.safe_text(F.col("id"))).alias("id"), F.lit("multi_doc_qa").alias("task"), "question", zipped.alias("documents"), "answer", meta.alias("meta")))


def paragraphs(df: DataFrame, split: str) -> DataFrame:
    """Rows of id, question, answer and paragraphs (structs of title, paragraph_text)."""
    body = lambda e: T.safe_text(e["paragraph_text"])
    docs = F.transform("paragraphs", lambda e, i: _record(doc_id=F.coalesce(F.nullif(T.safe_text(e["title"]), F.lit("")), F.concat(F.lit("para"), i + 1)), text=F.when(body(e) != "", T.strip(F.concat(T.safe_text(e["title"]), F.lit("\n"), body(e)))).otherwise("")))
    return normalized(df.select(F.concat(F.lit(f"musique_{split}_"), T.safe_text(F.col("id"))).alias("id"), F.lit("multi_doc_qa").alias("task"), "question", docs.alias("documents"), "answer", F.create_map(F.lit("source_task"), F.lit("musique")).alias("meta")))


def repositories(df: DataFrame, lang: str) -> DataFrame:
    """Rows of repo_name, file_path, import_statement, cropped_code, next_line, level and context (path, identifier, snippet)."""
    t = lambda c: T.safe_text(F.col(c))
    target = T.strip(F.concat(F.lit("Repository: "), t("repo_name"), F.lit("\nTarget file: "), t("file_path"), F.lit("\nImports:\n"), t("import_statement"), F.lit("\nCurrent code prefix:\n"), t("cropped_code")))
    others = F.transform(F.coalesce("context", F.array().cast("array<struct<path:string,identifier:string,snippet:string>>")), lambda e, i: _record(doc_id=F.format_string("ctx_%02d", i + 1), text=T.strip(F.concat(F.lit("Path: "), T.safe_text(e["path"]), F.lit("\nIdentifier: "), T.safe_text(e["identifier"]), F.lit("\nSnippet:\n"), T.safe_text(e["snippet"])))))
    docs = F.concat(F.array(_record(doc_id=F.lit("target_prefix"), text=target)), others)
    file = F.coalesce(F.nullif(t("file_path"), F.lit("")), F.lit("the target file"))
    name = F.concat_ws("_", F.lit("repobench"), F.lit(lang), F.substring(F.replace(t("repo_name"), F.lit("/"), F.lit("_")), 1, 24), F.substring(F.md5(F.concat_ws("|", t("repo_name"), t("file_path"), t("cropped_code"))), 1, 12))
    meta = F.create_map(F.lit("source_task"), F.lit("repobench"), F.lit("level"), t("level"), F.lit("language"), F.lit(lang))
    return normalized(df.select(name.alias("id"), F.lit("code_qa").alias("task"), F.concat(F.lit("What is the next line of code in `"), file, F.lit("`?")).alias("question"), docs.alias("documents"), F.col("next_line").alias("answer"), meta.alias("meta")))
