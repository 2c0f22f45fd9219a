"""Texts a model is given: evidence, facts and prompts. Nulls are empty texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T


def _filled(form: str, *values: Column | str | int) -> Column:
    """The form with each {} replaced by the next value."""
    parts = form.split("{}")
    out = [F.lit(parts[0])]
    for value, after in zip(values, parts[1:], strict=True):
        out += [F.coalesce((value if isinstance(value, Column) else F.lit(value)).cast("string"), F.lit("")), F.lit(after)]
    return F.concat(*out)


def evidence(chunks: Column, strip: list[str] | None = None, quote: bool = True, label: bool = True) -> Column:
    """All chunks (doc_id, chunk_id, text) in order: labelled, without the phrases to strip, fenced if quoted."""

    def line(c: Column) -> Column:
        body = T.safe_text(T.strip_phrases(c["text"], strip) if strip else c["text"])
        body = _filled("```\n{}\n```", body) if quote else body
        return _filled("【Evidence】{}#{}: {}", c["doc_id"], c["chunk_id"], body) if label else body

    return F.coalesce(F.array_join(F.transform(chunks, line), "\n"), F.lit(""))


def fact_lines(facts: Column, most: int = 6) -> Column:
    """The first ``most`` facts (content, doc_id, chunk_id), one to a line; of them blank ones are left out."""
    kept = F.filter(F.slice(facts, 1, max(1, most)), lambda f: T.safe_text(f["content"]) != "")
    return F.coalesce(F.array_join(F.transform(kept, lambda f: _filled("- {} ({}#{})", T.safe_text(f["content"]), f["doc_id"], f["chunk_id"])), "\n"), F.lit(""))


#: The forms of a baseline's, an agent's and a repairing prompt.
BASELINE = "你是一个严谨的问答助手。请只根据 Context 回答 Question，答案要简洁。\nQuestion: {}\nContext:\n{}\n请输出最终答案，不要输出推理过程。"
AGENT = (
    "你是端侧检索推理代理。你必须严格按协议输出：\n- 信息不足：<search>关键词</search>\n- 信息足够：<final>答案</final>\n不要输出其他文本。\n\n"
    "[STEP]\n{}\n[/STEP]\n[MAX_STEPS]\n{}\n[/MAX_STEPS]\n[MEMORY_STRATEGY]\n{}\n[/MEMORY_STRATEGY]\n[QUESTION]\n{}\n[/QUESTION]\n[EVIDENCE]\n{}\n[/EVIDENCE]\n[FACTS]\n{}\n[/FACTS]\n[NOTE]\n{}\n[/NOTE]\n"
)
REPAIR = "你上次输出不符合协议。仅允许以下两种格式之一：\n<search>关键词</search> 或 <final>答案</final>。\n不要输出任何其他文本。\n\n[REPAIR_OUTPUT]\n{}\n[/REPAIR_OUTPUT]\n[QUESTION]\n{}\n[/QUESTION]\n[EVIDENCE]\n{}\n[/EVIDENCE]\n"


def baseline_prompt(question: Column, context: Column) -> Column:
    return _filled(BASELINE, question, context)


def agent_prompt(question: Column, evidence_text: Column, step: Column | int, max_steps: Column | int, memory_strategy: Column | str, note: Column | str = "", facts_text: Column | str = "") -> Column:
    return _filled(AGENT, step, max_steps, memory_strategy, question, evidence_text, facts_text, note)


def repair_prompt(raw_output: Column, question: Column, evidence_text: Column) -> Column:
    return _filled(REPAIR, raw_output, question, evidence_text)


def text(form: str, *values) -> str:
    """As the prompts above, of one sample's values."""
    parts = form.split("{}")
    return parts[0] + "".join(f"{'' if v is None else v}{after}" for v, after in zip(values, parts[1:], strict=True))


def evidence_text(chunks: list[dict], strip: tuple[str, ...] = ()) -> str:
    """As `evidence`, of one sample's chunks."""
    lines = []
    for c in chunks:
        body = c["text"] or ""
        for phrase in strip:
            body = body.replace(phrase, "")
        lines.append(text("【Evidence】{}#{}: {}", c.get("doc_id"), c["chunk_id"], text("```\n{}\n```", body.strip())))
    return "\n".join(lines)


def facts_text(facts: list[dict], most: int = 6) -> str:
    """As `fact_lines`, of one sample's facts."""
    return "\n".join(text("- {} ({}#{})", f["content"].strip(), f["doc_id"], f["chunk_id"]) for f in facts[: max(1, most)] if f["content"].strip())
