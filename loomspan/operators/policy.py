"""What a bounded run may do for each sample: limits as configured, resolved to columns."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

SINGLE, MULTI = "single_doc_qa", "multi_doc_qa"


@dataclass
class Doubt:
    """When a final answer is doubtful: too short, with one of the markers, or with one of the tails."""

    enable: bool = False
    least: int = 24
    uncertain: list[str] = field(default_factory=lambda: list(T.UNCERTAIN))
    tails: list[str] = field(default_factory=lambda: list(T.CUT_TAILS))


@dataclass
class Forced:
    """A search in place of a first answer: how often, for how many chunks, and whether any first answer will do."""

    enable: bool = False
    most: int = 1
    top_k: int = 1
    any_final: bool = False


@dataclass
class TaskRules:
    """What a task changes; None leaves the run's own value."""

    top_k: int | None = None
    top_k_iter: int | None = None
    max_steps: int | None = None
    max_tokens: int | None = None
    temperature: float | None = None
    token_cap: int | None = None
    compact: str = "conservative"
    rewrite: bool | None = None
    doubt: Doubt = field(default_factory=Doubt)
    forced: Forced = field(default_factory=Forced)


@dataclass
class FastPath:
    """Kinds of questions that a short run answers."""

    kinds: list[str] = field(default_factory=lambda: ["count", "paragraph_id", "entity_short"])
    max_steps: int = 2
    refine: bool = False
    low_overlap: float = 0.12
    least: int = 1


@dataclass
class Generic:
    """Questions with one of the patterns in them, which name nothing to search for."""

    enable: bool = False
    patterns: list[str] = field(default_factory=list)
    max_steps: int = 2
    refine: bool = False


@dataclass
class LongContext:
    """Samples of one document whose texts have so many code points."""

    enable: bool = False
    least: int = 80_000
    top_k: int = 4
    max_steps: int = 4
    shortcut: bool = False
    refine: bool = True
    forced: bool = True


@dataclass
class EarlyStop:
    enable: bool = True
    same_keyword: int = 2
    no_new: int = 2
    shortcut: bool = False
    shortcut_step: int = 2
    rewrite: bool = True
    #: Several documents: a rewrite needs a search without new chunks.
    rewrite_needs_no_new: bool = True


@dataclass
class TokenCaps:
    """Caps on new tokens, lower for short questions."""

    enable: bool = False
    default: int | None = None
    short_question: int = 12
    short: int = 192


@dataclass
class Refine:
    """A second pass over an answer of one document, and what calls for it."""

    enable: bool = False
    always: bool = False
    repair_failed: bool = True
    doubtful: bool = True
    forced_final: bool = False
    max_tokens: int = 192
    temperature: float = 0.2


@dataclass
class Compact:
    """Whether answers are made short, to how many code points."""

    enable: bool = False
    most: int = 96
    single: bool = False
    entity: bool = False
    code: bool = False


@dataclass
class Limits:
    """A whole configuration; the defaults are a run's without any."""

    top_k: int = 3
    top_k_iter: int = 1
    max_steps: int = 6
    max_tokens: int = 256
    temperature: float = 0.2
    prompt_tokens: int = 8000
    memory: str = "fact_memory"
    facts: int = 6
    repairs: int = 1
    single_top_k: int = 3
    low_overlap: float = 0.18
    forced_needs_low_overlap: bool = True
    timeout_s: float = 0.0
    tasks: dict[str, TaskRules] = field(default_factory=dict)
    fast: FastPath = field(default_factory=FastPath)
    generic: Generic = field(default_factory=Generic)
    long: LongContext = field(default_factory=LongContext)
    stop: EarlyStop = field(default_factory=EarlyStop)
    caps: TokenCaps = field(default_factory=TokenCaps)
    refine: Refine = field(default_factory=Refine)
    compact: Compact = field(default_factory=Compact)

    def of(self, task: str | None) -> TaskRules:
        return self.tasks.get(task or "", TaskRules())


#: What `policy` adds.
COLUMNS = "kind fast generic long top_k top_k_iter max_steps temperature max_tokens shortcut refine forced".split()


def policy(samples: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Adds kind, fast, generic, long, top_k, top_k_iter, max_steps, temperature, max_tokens, shortcut, refine and forced.

    Needs id, task, question and context_chars. Null tasks and questions have the run's own limits.
    """
    limits = limits or Limits()
    rules = limits.tasks
    single = F.coalesce(F.col("task") == SINGLE, F.lit(False))

    def by_task(base, value) -> Column:
        """A value per task, where the task has rules that give one; else the base."""
        out = F.lit(base)
        for task, own in rules.items():
            if (v := value(own)) is not None:
                out = F.when(F.col("task") == task, F.lit(v)).otherwise(out)
        return out

    question = F.lower(T.safe_text(F.col("question")))
    named = F.when(F.contains(F.lower("id"), F.lit("passage_count")), "count").when(F.contains(F.lower("id"), F.lit("passage_retrieval")), "paragraph_id")
    kind = F.when(single, F.coalesce(named, T.answer_kind(F.col("question")))).otherwise("open_text")
    generic = F.lit(False)
    if limits.generic.enable and limits.generic.patterns:
        generic = single & reduce(lambda a, b: a | b, (F.contains(question, F.lit(p.lower())) for p in limits.generic.patterns))
    fast = single & F.col("kind").isin(limits.fast.kinds)
    long = single & (F.col("context_chars") >= limits.long.least) if limits.long.enable else F.lit(False)
    flagged = samples.withColumn("kind", kind).withColumns({"fast": fast, "generic": generic, "long": F.coalesce(long, F.lit(False))})

    steps = by_task(limits.max_steps, lambda r: max(limits.max_steps, r.max_steps) if r.max_steps is not None else None)
    steps = F.when(F.col("fast"), F.least(steps, F.lit(max(1, limits.fast.max_steps)))).otherwise(steps)
    steps = F.when(F.col("generic"), F.least(steps, F.lit(max(1, limits.generic.max_steps)))).otherwise(steps)
    steps = F.when(F.col("long"), F.greatest(steps, F.lit(limits.long.max_steps))).otherwise(steps)
    first = by_task(limits.top_k, lambda r: max(limits.top_k, r.top_k) if r.top_k is not None else None)
    of_single = max(limits.top_k, rules[SINGLE].top_k if SINGLE in rules and rules[SINGLE].top_k is not None else limits.single_top_k)
    first = F.when(F.col("long"), max(of_single, limits.long.top_k)).when(single, of_single).otherwise(first)
    tokens = by_task(limits.max_tokens, lambda r: r.max_tokens)
    if limits.caps.enable:
        caps = [F.lit(limits.caps.default)] if limits.caps.default is not None else []
        tokens = F.least(tokens, *caps, by_task(None, lambda r: r.token_cap).cast("int"), F.lit(2**31 - 1))
        short = F.size(T.query_tokens(F.col("question"))) <= max(1, limits.caps.short_question)
        tokens = F.when(short, F.least(tokens, F.lit(max(32, limits.caps.short)))).otherwise(tokens)
    blocked = F.lit(False)
    for flag, allowed in (("fast", limits.fast.refine), ("generic", limits.generic.refine), ("long", limits.long.refine)):
        blocked = blocked if allowed else blocked | F.col(flag)
    forced = by_task(False, lambda r: r.forced.enable) & ~F.col("generic")
    return flagged.withColumns(
        {
            "top_k": first.cast("int"),
            "top_k_iter": by_task(limits.top_k_iter, lambda r: max(1, r.top_k_iter) if r.top_k_iter is not None else None).cast("int"),
            "max_steps": steps.cast("int"),
            "temperature": by_task(limits.temperature, lambda r: r.temperature).cast("double"),
            "max_tokens": tokens.cast("int"),
            "shortcut": F.when(F.col("long"), limits.long.shortcut).otherwise(limits.stop.shortcut),
            "refine": F.lit(limits.refine.enable) & single & ~blocked,
            "forced": forced if limits.long.forced else forced & ~F.col("long"),
        }
    )
