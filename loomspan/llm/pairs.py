"""Defects of prompt and response pairs, by ordered rules over Spark's own expressions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package
from . import languages

ORDER = ("empty", "copied_question", "refusal", "wrong_language", "truncated")

_CLOSING = r"(?is)<\s*/\s*(?:final|search|answer)?\s*>?[\s\p{Cf}]*$"
_OPENING = r"(?is)^[\s\p{Cf}]*<?\s*(?:final|search|answer)\s*>"
_INTRO = r"(?iu)^\s*(?:answer|question|antwort|frage|bitte|please|q|a|you asked|the question (?:is|was)|sie fragten|答案(?:是|：|:)?|答|问题(?:是)?|问|您问(?:的是)?|你问(?:的是)?)\s*[:：.]?\s*"
#: Characters that end a sentence; the semicolons end clauses that stand alone here.
_ENDS = r"""[.!?;。！？；…"”’'»)）\]】}」』`]"""

#: What stands for a missing answer, as cores.
PLACEHOLDERS = (
    "na null none nil nan tbd todo undefined missing unknown empty blank noanswer notavailable notapplicable noresponse placeholder "
    "keineangabe keineangaben unbekannt leer fehlt 无 暂无 空 未知 待定 待补充 缺失 无答案 没有答案 暂缺"
).split()

#: Answers of one word to a question of yes or no, as cores.
AGREEMENTS = "yes no true false ja nein oui non sí si 是 是的 否 不是 不是的 对 对的 不对 没有 有 有的 不是".split()

#: How a writer declines or says that they cannot answer, in the first person or without one.
#: Reports of someone else's refusal ("X declined to answer", "said it could not be told") are none.
_REPORTED = r"(?<!\b(?:said|says|say|claimed|claims|added|noted|wrote|stated|argued|thought|explained|held|felt) (?:that )?)"
_UNSURE = r"(?:answer|answered|settle|settled|say|said|tell|told|determine|determined|resolve|resolved|know|known|establish|established|decide|decided|help|assist|respond|comment|provide|give|given|offer)"
REFUSALS = {
    "en": (
        r"\b(?:i|we) (?:am|are|was|were)? ?(?:\p{L}+ )?(?:not able|unable|not in a position|not allowed|not permitted|not willing|unwilling|not going)\b",
        r"\b(?:i'm|we're) (?:\p{L}+ )?(?:not able|unable|afraid (?:i|we|that)|not in a position|not allowed|not permitted|not willing|unwilling|not going|not sure)\b",
        r"\b(?:i|we) (?:\p{L}+ ){0,2}(?:cannot|can't|can not|could not|couldn't|won't|will not|do not know|don't know|have no idea|have no way|lack the|must decline|must refuse|must pass|decline|refuse|have to (?:decline|pass|refuse)|would rather not|would prefer not)\b",
        r"\b(?:i'd|we'd|i'll|we'll) (?:\p{L}+ )?(?:rather not|prefer not|have to (?:decline|pass|refuse))\b",
        r"^(?:i'm |i am |we are |we're )?(?:very |so |truly )?(?:sorry|apologies|my apologies)\b[,;.!]",
        r"^(?:i'm|i am|we are|we're) (?:very |so |truly )?sorry\b",
        r"^(?:i|we) apologi[sz]e\b",
        r"\bas an? (?:ai|large|language|ai language|large language)[ -]?(?:language )?(?:model|assistant)\b",
        r"\b(?:beyond|outside) (?:what (?:i|we) (?:can|could|am|are|know)|(?:my|our) (?:knowledge|abilit\p{L}+|capabilit\p{L}+|scope|reach|remit|power))\b",
        rf"{_REPORTED}\bimpossible (?:for (?:me|us) )?to {_UNSURE}\b",
        r"\b(?:(?:would|could|can) (?:only |just |merely )?be|is|am|i'd be|be) (?:only |just |mere |pure |merely )?(?:guesswork|guessing|speculation|speculating)\b",
        r"\bno (?:clear |definite |reliable |useful )?(?:answer|reply|response|statement) (?:can|could|will|is) (?:be )?(?:given|made|offered|provided|possible)\b",
        r"\bnothing (?:i|we) (?:can|could) (?:\p{L}+)\b",
        rf"{_REPORTED}\b(?:question|request|this|it|that) (?:cannot|can't|can not|could not|couldn't) (?:\p{{L}}+ )?be {_UNSURE}\b",
        rf"\bunable to {_UNSURE}\b",
        r"\b(?:not|insufficient|too little|no) (?:enough )?(?:information|evidence|context|data)\b.{0,30}\bto (?:answer|say|tell|determine|decide)\b",
    ),
    "de": (
        r"\bsprachmodell\b",
        r"^(?:tut mir leid|es tut mir leid|entschuldigung|entschuldigen sie|verzeihung|ich bedaure|bedaure|bedauerlicherweise (?:kann|muss|ist|darf))\b",
        r"^leider (?:kann|muss|ist|darf|lässt|können|weiß|fehlen)\b",
        r"\b(?:kann|darf|möchte|will|werde) (?:ich|wir) (?:\p{L}+ ){0,4}(?:nichts?|keine)\b",
        r"\b(?:ich|wir) (?:kann|darf|möchte|will|werde|weiß|können|dürfen|möchten|wissen) (?:\p{L}+ ){0,5}(?:nichts?|keine)\b",
        r"\bmuss ich (?:\p{L}+ ){0,3}(?:passen|ablehnen|verzichten)\b",
        r"\bich (?:muss|möchte) (?:\p{L}+ ){0,3}(?:passen|ablehnen|verzichten)\b",
        r"\bmir (?:\p{L}+ ){0,3}(?:keine auskunft|keine antwort|nicht) (?:möglich|bekannt)\b",
        r"\blässt sich (?:\p{L}+ ){0,4}nicht (?:klären|beantworten|sagen|feststellen|bestimmen)\b",
        r"\bkeine (?:antwort|auskunft|aussage) (?:möglich|geben)\b",
    ),
    "zh": (
        r"^(?:很|非常|十分)?(?:抱歉|对不起|不好意思|遗憾)",
        r"语言模型",
        r"我(?:也|还|暂时|目前|实在)?(?:无法|不能|不便|没法|没有办法|不会|拒绝|不予|不愿|不知道|不清楚)",
        r"恕(?:难|我|不)",
        r"无从(?:回答|作答|得知|判断|知晓)",
        r"没有办法(?:给出|回答|确定|判断)",
        r"超出了?我",
        r"无法(?:回答|作答|给出|确定|提供|判断)(?:这|该|此|答|结|任|相|，|。|$)",
        r"难以(?:回答|作答|判断)",
        r"不予(?:回答|回应|作答)(?:，|。|$)",
    ),
    "other": (
        r"\b(?:je suis désolé|désolé[,.]|je ne (?:peux|sais|puis) pas|lo siento|no puedo (?:responder|ayudar|contestar)|mi dispiace|non posso (?:rispondere|aiutare)|não posso responder|desculpe|het spijt me|ik kan (?:\p{L}+ ){0,3}niet)\b",
        r"(?:извините|не могу ответить|申し訳|答えられません|お答えできません|죄송)",
    ),
}


def core(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{Nd}]", "")


def without_tags(c: Column) -> Column:
    """The answer without a leading and a closing tag, whole or malformed, and surrounding space."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), _OPENING, "")
    c = F.regexp_replace(c, _CLOSING, "")
    c = F.regexp_replace(c, r"(?is)(?:<|</)?(?:final|search)>[\s\p{Cf}]*$", "")
    return strip(c)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^[\s\p{Cf}]+|[\s\p{Cf}]+$", "")


def _introduced(c: Column) -> Column:
    """A text without such openings as 'Answer:'."""
    return F.regexp_replace(c, _INTRO.replace(r"\s*[:：.]?\s*", r"\s*(?:[:：.]|(?<=是))\s*"), "")


def is_search(answer: Column) -> Column:
    """A search request rather than an answer."""
    return F.coalesce(answer.rlike(r"(?i)^[\s\p{Cf}]*<?\s*search\s*>"), F.lit(False))


def is_empty(bare: Column) -> Column:
    """Of the core of an answer without opening."""
    return (bare == "") | bare.isin(*PLACEHOLDERS)


def is_refusal(plain: Column) -> Column:
    """Of an answer in lower case with plain apostrophes."""
    return plain.rlike("(?u)(?:" + "|".join(p for group in REFUSALS.values() for p in group) + ")")


def is_copy(answer: Column, a: Column, q: Column) -> Column:
    """Only the question: as it is, with up to a fifth of it changed, after an opening, or twice.

    ``a`` and ``q`` are the cores of answer and question without openings.
    """
    n, m = F.length(q), F.length(a)
    slack = F.greatest(F.lit(2), F.floor(n * 0.2)).cast("int")
    near = lambda x, y, d: F.call_function("levenshtein", x, y, d) >= 0  # noqa: E731  # of the matrix only a band of that width; -1 beyond
    alone = (F.abs(n - m) <= slack) & near(a, q, slack)
    opened = (m > n) & (m - n <= 40) & near(F.right(a, n), q, (n * 0.1).cast("int"))
    twice = (F.abs(m - 2 * n) <= 2 * slack) & near(a, F.concat(q, q), 2 * slack)
    # a question that is repeated and then answered isn't a mere copy
    tail = core(F.regexp_extract(answer, r"(?s)[?？.。!！]\s*([^?？]*?)$", 1))
    head = F.left(a, m - F.length(tail))
    more = (F.length(tail) > 0) & (m > F.length(tail)) & (F.length(head) >= n - slack) & near(head, q, slack) & ~near(tail, q, slack)
    more = more | ((m > n) & (F.left(a, n) == q))
    return F.coalesce((n >= 6) & (m >= n - slack) & (m <= F.greatest(n + 40, 2 * n + 2 * slack)) & (twice | ((alone | opened) & ~more)), F.lit(False))


_BRACKETS = ((r"\(|（", r"\)|）"), (r"\[|【", r"\]|】"), (r"\{", r"\}"), ("“", "”"), ("「", "」"), ("《", "》"))


def with_truncated(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds whether an answer, without opening and outer space, ends within a word, phrase or bracket.

    The last sentence has no end and isn't a bare name, number, yes or no, or code; or a
    bracket, quotation or back-tick isn't closed.
    """
    a = F.col(text)
    count = lambda p: F.regexp_count(a, F.lit(p))
    opened = reduce(lambda x, y: x | y, (count(o) > count(c) for o, c in _BRACKETS))
    opened = a.rlike("[(（\\[【{“「《`]") & (opened | (count("`") % 2 == 1))
    before = r"(?s)^.*([.!?;…]\s+|[。！？；]\s*)(?=\S)"
    df = df.withColumns({"_opened": opened, "_ended": a.rlike(_ENDS + r"$")})
    df = df.withColumns({"_last": F.when(~F.col("_ended"), F.regexp_replace(a, before, "")), "_after": F.when(~F.col("_ended"), F.regexp_extract(a, before, 1))})
    last = F.col("_last")
    number = last.rlike(r"^[\p{Sc}~≈+-]?\s*\d[\d.,:/ -]*\s*(?:%|\p{L}{0,3})$")
    name = last.rlike(r"^\p{Lu}[\p{L}'’.-]*(?:\s+(?:\p{Lu}[\p{L}'’.-]*|\d{1,4}|von|van|de|of|the|und|and)){0,3}$") & ~last.rlike(r"\s(?:von|van|de|of|the|und|and|\d+)$")
    han = last.rlike(r"^[\p{IsHan}·]{1,7}$") & ~last.rlike("[的于由在当并被与和]$")
    word = last.rlike(r"^[\p{L}\p{N}_.'’-]+$") & ~last.rlike(r"\p{IsHan}")
    code = last.rlike(r"^(?:return|import|from|def|class|if|for|while|print|self|[A-Za-z_][\w.]*\s*(?:=|\(|\[))\b?.*[\w)\]};:]$") & ~last.rlike(r"^(?:if|for|from|while|return)\s+\p{L}+\s+\p{L}+\s+\p{L}+")
    agreed = core(last).isin(*AGREEMENTS)
    bare = number | code | agreed | ((name | han | word) & (F.regexp_replace("_after", r"[?？\s]", "") == ""))
    return df.withColumn(out, F.coalesce((F.length(a) > 0) & (F.col("_opened") | (~F.col("_ended") & ~bare)), F.lit(False))).drop("_opened", "_ended", "_last", "_after")


def defects(pairs: DataFrame) -> DataFrame:
    """``pairs`` (question, answer and any other columns) with ``defects``: every triggered type, in order.

    An empty answer has only that defect, and a search request no other. A null question
    triggers neither a copy nor a wrong language. The answer's tags are no part of it.
    Rules on text are expressions, each step a projection of its own; languages are told
    in batches, after which no filter can move the rules into itself.
    """
    ship_package(pairs.sparkSession)
    df = pairs.withColumn("_own", without_tags(F.col("answer")))
    df = df.withColumn("_own", strip(_introduced(F.col("_own"))))
    df = df.withColumns({"_a": core(F.col("_own")), "_q": core(_introduced(F.col("question"))), "_lower": F.regexp_replace(F.lower("_own"), "[’`]", "'")})
    df = with_truncated(df, "_own", "_truncated")
    flags = {
        "_empty": is_empty(F.col("_a")),
        "_search": is_search(F.col("answer")),
        "copied_question": is_copy(F.col("_own"), F.col("_a"), F.col("_q")),
        "refusal": is_refusal(F.col("_lower")),
        # a question without its mark, and then a short answer, has no end either
        "truncated": F.col("_truncated") & ~F.coalesce((F.length("_q") >= 6) & F.startswith("_a", "_q") & (F.length("_a") - F.length("_q")).between(1, 12), F.lit(False)),
    }
    marked = df.select(*pairs.columns, F.col("question").alias("_asked"), "_own", *(F.coalesce(c, F.lit(False)).alias(f"_is_{n}") for n, c in flags.items()))
    schema = ", ".join(f"`{n}` {t}" for n, t in pairs.dtypes)
    names = list(flags)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked, own = batch.column(width).to_pylist(), batch.column(width + 1).to_pylist()
            told = [dict(zip(names, row)) for row in zip(*(batch.column(width + 2 + i).to_pylist() for i in range(len(names))))]
            found = []
            for q, a, is_ in zip(asked, own, told):
                if is_["_empty"]:
                    found.append(["empty"])
                elif is_["_search"]:
                    found.append([])
                else:
                    is_["wrong_language"] = in_another_language(q, a)
                    found.append([k for k in ORDER[1:] if is_[k]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.array(found, pa.list_(pa.string()))], names=[*batch.schema.names[:width], "defects"])

    width = len(pairs.columns)
    return marked.mapInArrow(run, f"{schema}, defects array<string>")


def in_another_language(question: str | None, answer: str | None) -> bool:
    """Whether the answer's language can be told and the question is clearly in another one, or in another script."""
    spoken = languages.language(answer)
    return spoken is not None and languages.other_than(question, spoken)
