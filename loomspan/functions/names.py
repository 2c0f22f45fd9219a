"""Names and tags taken from ids, paths and questions, and the parts of a model's reasoning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as T


def dataset_of(sample_id: Column) -> Column:
    """A sample's source from its id: without a leading 'lb_' and the last part."""
    return F.regexp_replace(F.regexp_replace(sample_id, "^lb_", ""), "_[^_]*$", "")


def question_hash(question: Column, width: int = 16) -> Column:
    """The beginning of a question's SHA-1; of an empty text for null."""
    return F.substring(F.sha1(F.coalesce(question, F.lit(""))), 1, width)


def short_name(sample_id: Column, width: int = 24) -> Column:
    """An id with slashes for underscores, cut."""
    return F.substring(F.replace(sample_id, F.lit("_"), F.lit("/")), 1, width)


def method_of(path: Column) -> Column:
    """A file's name without its ending."""
    return F.regexp_extract(path, r"([^/]+)\.[^./]+$", 1)


def run_tag(path: Column, given: Column | None = None) -> Column:
    """A run's tag: as given, else the last part of its path that begins with 'seed_', else the folder's name."""
    named = [F.nullif(given, F.lit(""))] if given is not None else []
    return F.coalesce(*named, F.nullif(F.regexp_extract(path, ".*(seed_[^/]*)", 1), F.lit("")), F.regexp_extract(path, "([^/]+)/[^/]+$", 1))


def last_line(reasoning: Column) -> Column:
    """The last line with text; empty if there is none."""
    lines = F.filter(F.transform(F.split(F.coalesce(reasoning, F.lit("")), "\n"), T.strip), lambda s: s != "")
    return F.when(F.size(lines) > 0, F.element_at(lines, -1)).otherwise("")


def switched(prompt: Column, switch: str) -> Column:
    """A prompt that begins with the switch."""
    own = F.coalesce(prompt, F.lit(""))
    return F.when(F.startswith(own, F.lit(switch)), own).otherwise(F.concat(F.lit(switch + " "), own))


def generic_pattern(question: Column, patterns: list[str]) -> Column:
    """The first of the patterns that a question has in it, whatever the case; else empty."""
    low = F.lower(T.safe_text(question))
    found = F.filter(T.lit_array(patterns), lambda p: F.contains(low, F.lower(p)))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(""))
