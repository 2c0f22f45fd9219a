"""Column functions over questions, answers and evidence texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it; the same class works in Java and in RE2.
WS = r"[\s\x0B\x{85}\p{Z}]"

#: Punctuation that scoring ignores.
SCORED_PUNCTUATION = "，。！？、,.!?;:\"'`（）()[]{}<>《》"
#: Words that keyword search ignores.
STOP_WORDS = "的 了 是 在 和 与 请 根据 只 回答 what is the a an".split()
#: What marks a question's kind, tried in this order.
QUESTION_KINDS = {
    "count": ["how many", "number of", "count", "多少", "几个", "几种", "数量"],
    "paragraph_id": ["paragraph", "段落", "第几段", "哪一段"],
    "entity_short": ["who", "where", "when", "which", "what", "谁", "哪里", "哪位", "何时", "哪个"],
}
#: Phrases and tails that make an answer doubtful; parameters of low_confidence.
UNCERTAIN = ["not sure", "unclear", "unknown", "cannot", "无法", "不确定", "不清楚"]
CUT_TAILS = [",", ":", ";", " and", " or", " which", " that", "，", "：", "；"]
#: Texts that evidence shouldn't smuggle into a prompt; a parameter of strip_phrases.
INJECTED = ["ignore previous", "system prompt", "you are now"]


def lit_array(values: list[str]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def strip(c: Column) -> Column:
    """Without white space, of any kind, at either end."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def safe_text(c: Column) -> Column:
    """Null as an empty text; else without white space at either end."""
    return strip(F.coalesce(c, F.lit("")))


def squeezed(c: Column) -> Column:
    """Lower case with each run of white space as one space."""
    return F.regexp_replace(F.lower(safe_text(c)), f"{WS}+", " ")


def scored(c: Column) -> Column:
    """The form in which answers are compared: lower case, no white space, no listed punctuation."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), f"{WS}+", ""), r"[，。！？、,.!?;:\"'`（）()\[\]{}<>《》]", "")


def code_points(c: Column) -> Column:
    """A text's code points as an array; none of an empty text."""
    return F.filter(F.split(c, ""), lambda x: x != "")


def exact_match(pred: Column, gold: Column) -> Column:
    return (scored(pred) == scored(gold)).cast("double")


def bag_tokens(c: Column) -> Column:
    """Tokens of lexical scoring: at single spaces if there is one, else code points."""
    t = F.lower(safe_text(c))
    words = F.filter(F.split(t, " "), lambda x: x != "")
    return F.when(F.contains(t, F.lit(" ")), words).otherwise(F.filter(code_points(t), lambda x: ~x.rlike(f"^{WS}$")))


def query_tokens(c: Column) -> Column:
    """Runs of ASCII letters, digits and underscores, and single CJK ideographs, in lower case."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("([a-z0-9_]+|[一-鿿])"), F.lit(1))


def keyword_tokens(c: Column) -> Column:
    stop = lit_array(STOP_WORDS)
    return F.filter(query_tokens(c), lambda x: ~F.array_contains(stop, x))


def rewritten(question: Column, keyword: Column, cap: int = 10) -> Column:
    """A search query of the first ``cap`` distinct tokens of question and keyword."""
    merged = F.slice(F.array_distinct(F.concat(query_tokens(question), query_tokens(keyword))), 1, cap)
    return F.when(F.size(merged) > 0, F.array_join(merged, " ")).otherwise(F.coalesce(F.nullif(safe_text(keyword), F.lit("")), safe_text(question)))


def forced_keyword(question: Column, fallback: Column, cap: int = 8) -> Column:
    merged = F.slice(F.array_distinct(query_tokens(question)), 1, cap)
    return F.when(F.size(merged) > 0, F.array_join(merged, " ")).otherwise(F.coalesce(F.nullif(safe_text(fallback), F.lit("")), safe_text(question)))


def first_keywords(question: Column, cap: int = 4, default: str = "关键信息") -> Column:
    kept = F.slice(keyword_tokens(question), 1, cap)
    return F.when(F.size(kept) > 0, F.array_join(kept, " ")).otherwise(default)


def approx_tokens(c: Column, empty: int = 0) -> Column:
    """Half a text's length, at least 1; ``empty`` of an empty or null text."""
    n = F.length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, F.lit(empty)).otherwise(F.greatest(F.lit(1), F.floor(n / 2).cast("int"))).cast("long")


def _contains_any(text: Column, markers: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(m)) for m in markers if m), F.lit(False))


def answer_kind(question: Column, kinds: dict[str, list[str]] | None = None) -> Column:
    """count, paragraph_id, entity_short or open_text, by the first kind that has a marker in the question."""
    q = F.lower(safe_text(question))
    out = F.when(q == "", "open_text")
    for kind, markers in (kinds or QUESTION_KINDS).items():
        out = out.when(_contains_any(q, markers), kind)
    return out.otherwise("open_text")


def evidence_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct tokens that the text has; 0 without question tokens."""
    q = F.array_distinct(query_tokens(question))
    return F.when(F.size(q) == 0, 0.0).otherwise(F.size(F.array_intersect(q, query_tokens(text))) / F.size(q))


def first_number(c: Column) -> Column:
    """The first number that doesn't continue a word, without commas and a final '.0'; else empty."""
    raw = F.regexp_extract(F.coalesce(c, F.lit("")), r"(^|[^a-zA-Z0-9_])(-?\d+(?:[.,]\d+)?)", 2)
    return F.regexp_replace(F.replace(raw, F.lit(","), F.lit("")), r"\.0$", "")


def paragraph_number(c: Column) -> Column:
    """The number of a named paragraph, by four forms in order; else empty."""
    c = F.coalesce(c, F.lit(""))
    forms = [r"(?i)\bparagraph\s*(\d+)\b", r"(?i)\bpara\s*(\d+)\b", r"段落\s*(\d+)", r"第\s*(\d+)\s*段"]
    return F.coalesce(*(F.nullif(F.regexp_extract(c, f, 1), F.lit("")) for f in forms), F.lit(""))


def short_entity(c: Column, most: int = 48) -> Column:
    """The first sentence without outer punctuation, cut to ``most`` code points."""
    src = safe_text(c)
    first = strip(F.split(src, r"[\n。！？!?]")[0])
    first = F.when(first == "", src).otherwise(first)
    first = F.regexp_replace(first, "^[ \"'`:,;：；]+|[ \"'`:,;：；]+$", "")
    return F.when(F.length(first) > most, F.regexp_replace(F.substring(first, 1, most), "[ ,:;：；]+$", "")).otherwise(first)


def low_confidence(pred: Column, question: Column, kind: Column, least: int = 24, uncertain: list[str] | None = None, tails: list[str] | None = None) -> Column:
    """Reasons to doubt an answer, joined by ';'; empty if there is none."""
    text = safe_text(pred)
    low, q = F.lower(text), safe_text(question)
    no_digit = ~text.rlike("[0-9]")
    ends = reduce(lambda a, b: a | b, (F.endswith(low, F.lit(t)) for t in (tails or CUT_TAILS)))
    reasons = [
        F.when(F.length(text) < least, "short_answer"),
        F.when(_contains_any(low, uncertain or UNCERTAIN), "uncertainty_marker"),
        F.when(ends, "truncated_tail"),
        F.when((kind == "paragraph_id") & ~text.rlike(r"(?i)\bparagraph\s*[0-9]+\b") & ~text.rlike(r"第\s*[0-9]+\s*段"), "paragraph_id_missing"),
        F.when((kind == "entity_short") & (F.length(text) > 220), "entity_too_long"),
        F.when((kind == "count") & no_digit, "count_missing_number"),
        F.when((F.startswith(F.lower(q), F.lit("how many")) | F.startswith(q, F.lit("多少"))) & no_digit, "count_missing_number"),
    ]
    return F.when(text == "", "empty").otherwise(F.array_join(F.filter(F.array(*reasons), lambda x: x.isNotNull()), ";"))


def strip_phrases(c: Column, phrases: list[str] | None = None) -> Column:
    """Without the listed phrases, each taken out in turn and by its exact letters."""
    return reduce(lambda t, p: F.replace(t, F.lit(p), F.lit("")), phrases or INJECTED, F.coalesce(c, F.lit("")))


def strict_tag(c: Column) -> tuple[Column, Column]:
    """Tag and content of an output that is one final or one search element; nulls otherwise."""
    t = safe_text(c)
    parts = {tag: F.regexp_extract(t, f"(?is)^<{tag}>(.*?)</{tag}>$", 1) for tag in ("final", "search")}
    has = {tag: t.rlike(f"(?is)^<{tag}>.*</{tag}>$") for tag in parts}
    one = has["final"] != has["search"]
    tag = F.when(one & has["final"], "final").when(one & has["search"], "search")
    return tag, F.when(tag == "final", strip(parts["final"])).when(tag == "search", strip(parts["search"]))


def relaxed_tag(c: Column) -> tuple[Column, Column]:
    """As strict_tag, but the element may stand anywhere, miss its end or its first bracket."""
    t = safe_text(c)
    whole = r"(?is)<\s*(final|search)\s*>(.*?)<\s*/\s*\1\s*>"
    found = t.rlike(whole)
    tag, content = F.when(found, F.lower(F.regexp_extract(t, whole, 1))), F.when(found, strip(F.regexp_extract(t, whole, 2)))
    for opening in ("<final>", "<search>"):
        rest = strip(F.regexp_extract(t, f"(?is)^.*?{opening}(.*)$", 1))
        take = tag.isNull() & (rest != "")
        tag, content = F.when(take, opening[1:-1]).otherwise(tag), F.when(take, rest).otherwise(content)
    for opening in ("final", "search"):
        rest = strip(F.regexp_extract(t, f"(?is)^.*?{opening}>(.*)$", 1))
        rest = strip(F.regexp_replace(rest, f"(?is)</{opening}>.*$", ""))
        take = tag.isNull() & (rest != "")
        tag, content = F.when(take, opening).otherwise(tag), F.when(take, rest).otherwise(content)
    return tag, content


def best_sentence(question: Column, context: Column) -> Column:
    """The first sentence that has most of the question's keywords in it."""
    parts = F.filter(F.transform(F.split(F.coalesce(context, F.lit("")), r"[\n。！？!?]"), strip), lambda s: s != "")
    keys = keyword_tokens(question)
    rated = F.transform(parts, lambda s, i: F.struct(F.size(F.filter(keys, lambda k: F.contains(F.lower(s), k))).alias("n"), (-i).alias("at"), s.alias("s")))
    return F.coalesce(F.array_max(rated)["s"], F.substring(F.coalesce(context, F.lit("")), 1, 160))


def context(documents: Column) -> Column:
    """The texts of all documents in order, one to a line; null texts and null documents are empty."""
    return F.coalesce(F.array_join(F.transform(documents, lambda e: F.coalesce(e["text"], F.lit(""))), "\n"), F.lit(""))


def typed_answer(text: Column, kind: Column) -> Column:
    """A count's digits, a paragraph's name, yes or no, or the first sentence, by kind."""
    src = safe_text(text)
    digits = F.regexp_extract(src, "([0-9]+)", 1)
    number = F.coalesce(F.nullif(F.regexp_extract(src, r"(?i)\bparagraph\s*([0-9]+)\b", 1), F.lit("")), F.nullif(F.regexp_extract(src, r"第\s*([0-9]+)\s*段", 1), F.lit("")))
    yes = F.lower(F.regexp_extract(src, r"(?i)^(yes|no)\b", 1))
    first = F.regexp_extract(src, r"(?s)^(.*?[.!?。！？])\s+.", 1)
    out = F.when((kind == "count") & (digits != ""), digits).when((kind == "paragraph_id") & number.isNotNull(), F.concat(F.lit("Paragraph "), number))
    return out.when((kind == "entity_short") & (yes != ""), yes).when((kind == "entity_short") & (F.length(first) >= 3), first).otherwise(src)
