"""Answers of a model as they are scored: in prose, in code, and short. Nulls are empty answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T

#: What an answer may open with before it begins. Words first, then labels, which end with a colon.
PROSE_WORDS = ["wait", "maybe", "however", "well", "i think", "it seems", "let me", "i'm not sure", "not sure"]
PROSE_LABELS = ["answer", "final answer"]
CODE_WORDS = ["wait", "however", "alternatively", "but"]
CODE_LABELS = ["the next line of code is", "the next line of code", "answer", "final answer", "path", "identifier", "snippet"]
#: How an answer may break off.
LOOSE_ENDS = [" which", " that", " and", " or", ",", ":", ";"]
#: Words a line of code may begin with.
CODE_STARTS = "public private protected return if for while try catch class def async await const let var".split()
#: Where a span that answers a question begins, by a word that the question has and whether it begins with it.
SPANS = [
    ("where", True, r"\b(?:born|located|in) +in +([^.;,\n]+(?:, *[^.;,\n]+)?)"),
    ("who", True, r"\bwas +([^.;,\n]+)"),
    ("who", True, r"\bis +([^.;,\n]+)"),
    ("position", False, r"\bposition of +([^.;,\n]+)"),
    ("", False, r"\bwas born in +([^.;,\n]+(?:, *[^.;,\n]+)?)"),
]
#: The first of several sentences.
FIRST_SENTENCE = r"(?s)^(.*?[.!?。！？])\s+\S"


def opening_pattern(words: list[str], labels: list[str]) -> str:
    """All openings in a row, however many."""
    return rf"(?i)^(?:\s*(?:(?:{'|'.join(words)})\b[\s,:-]*|(?:{'|'.join(labels)})\s*[:：]\s*))+"


def loose_end_pattern(ends: list[str]) -> str:
    return rf"(?i)[ ,:;]*(?:{'|'.join(ends)})$"


def code_line_pattern(starts: list[str]) -> str:
    return rf"(?i)^[@#]|^(?:{'|'.join(starts)})\b|[;{{}}()]|^[a-z_]\w*\s*[:=]"


def _single_spaced(c: Column) -> Column:
    return T.strip(F.regexp_replace(c, f"{T.WS}+", " "))


def _without(c: Column, ends: str) -> Column:
    """Without any of the given characters at either end."""
    return F.regexp_replace(c, f"^[{ends}]+|[{ends}]+$", "")


def _cut(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.regexp_replace(F.substring(c, 1, most), "[ ,;]+$", "")).otherwise(c)


def prose(c: Column, ramble: int = 220, least: int = 8) -> Column:
    """No opening, no loose end, single spaces; of an answer over ``ramble`` or that waits only the first sentence, if it has ``least`` code points."""
    source = T.safe_text(c)
    begun = T.strip(F.regexp_replace(source, opening_pattern(PROSE_WORDS, PROSE_LABELS), ""))
    ended = F.regexp_replace(begun, loose_end_pattern(LOOSE_ENDS), "")
    first = F.regexp_extract(ended, FIRST_SENTENCE, 1)
    rambles = (F.length(ended) > ramble) | F.contains(F.lower(source), F.lit("wait"))
    return _single_spaced(F.when(rambles & (F.length(first) >= least), first).otherwise(ended))


def code(c: Column, most: int = 160) -> Column:
    """Out of fences and back-ticks: the first code between single ones, else the first line that looks like code, else the first line; cut to ``most``."""
    lines_of = lambda x: F.filter(F.transform(x, T.strip), lambda v: v != "")
    unified = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bare = T.strip(F.regexp_replace(unified, r"```[\w+-]*", ""))
    quoted = F.try_element_at(lines_of(F.regexp_extract_all(bare, F.lit(r"`([^`\n]+)`"), F.lit(1))), F.lit(1))
    begun = T.strip(F.regexp_replace(F.coalesce(quoted, bare), opening_pattern(CODE_WORDS, CODE_LABELS), ""))
    lines = lines_of(F.split(begun, "\n"))
    chosen = F.coalesce(F.try_element_at(F.filter(lines, lambda v: v.rlike(code_line_pattern(CODE_STARTS))), F.lit(1)), F.try_element_at(lines, F.lit(1)), F.lit(""))
    return _cut(_without(_single_spaced(_without(chosen, " `")), " ,;"), most)


def compact(c: Column, question: Column, most: int = 96, first_sentence: bool = True, spans: bool = True, cut: bool = True, least: int = 4) -> Column:
    """The span that the question's words ask for, else the first sentence, without markup, cut to ``most``."""
    source, asked = T.safe_text(c), F.lower(T.safe_text(question))
    tries = []
    for word, begins, pattern in SPANS if spans else []:
        fits = F.startswith(asked, F.lit(word)) if begins else F.contains(asked, F.lit(word))
        span = _without(F.regexp_extract(source, "(?i)" + pattern, 1), " .,:;")
        tries.append(F.when(fits & (span != ""), span))
    first = T.strip(F.regexp_extract(source, FIRST_SENTENCE, 1))
    plain = F.when(F.length(first) >= least, first).otherwise(source) if first_sentence else source
    out = _without(_single_spaced(F.regexp_replace(F.coalesce(*tries, plain), "[*_`]+", "")), " ,;")
    return _cut(out, most) if cut else out


def cleaned(task: Column, text: Column, question: Column) -> Column:
    """By task: code as code, multi-document answers made short, all others as prose."""
    return F.when(task == "code_qa", code(text)).when(task == "multi_doc_qa", compact(text, question)).otherwise(prose(text))
