"""A bounded retrieve-and-answer loop around a pluggable model.

Policy is a projection (`policy`): every limit of a sample is resolved to a column first.
The loop itself, whose model is opaque and stateful, runs as one Python call per sample
over the sample's own chunks, which are grouped into its row before; samples are
independent, so any number of tasks share them. What becomes of an answer afterwards is an
expression again (`finished`).
"""

from __future__ import annotations

import re
import threading
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field
from math import sqrt

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions import text as T
from ..session import ship_package
from . import prompts
from .memory import NOT_ENOUGH
from .models import Controller, PromptModel, mock_model, tokens
from .policy import COLUMNS, MULTI, SINGLE, Limits, policy
from .skew import hot_values, spread_join

Model = Controller | PromptModel
_STEP = (
    "step:int,tag:string,content:string,keyword:string,hits:array<string>,fresh:array<string>,same_keyword:int,no_new:int,rewritten:string,forced:string,"
    "repairs:int,repair_failed:boolean,model_failed:boolean,doubt:string,overlap:double,dropped:array<string>,stop:string"
)
_FIELDS = "id string, task string, question string, kind string, raw string, refined string, n_steps int, n_retrieval int, chunks_total int, prompt_tokens int, completion_tokens int, error_count int, stop_reason string, keywords array<string>"
RESULT = f"{_FIELDS}, steps array<struct<{_STEP}>>"
_NUMBER = re.compile(r"(?<![a-zA-Z0-9_])-?\d+(?:[.,]\d+)?")
_PARAGRAPHS = [re.compile(p) for p in (r"(?i)\bparagraph\s*(\d+)\b", r"(?i)\bpara\s*(\d+)\b", r"段落\s*(\d+)", r"第\s*(\d+)\s*段")]
_LEAST_ANSWER = 24


def parsed(raw: str | None) -> tuple[str | None, str]:
    """Tag and content: one whole element, else one anywhere, cut short or without its first bracket."""
    text = (raw or "").strip()
    for tag in ("final", "search"):
        if match := re.fullmatch(rf"<{tag}>(.*?)</{tag}>", text, re.S | re.I):
            return tag, match[1].strip()
    if match := re.search(r"<\s*(final|search)\s*>(.*?)<\s*/\s*\1\s*>", text, re.S | re.I):
        return match[1].lower(), match[2].strip()
    for form in (r"<{}>(.+)", r"{}>(.+?)(?:</{}>|$)"):
        for tag in ("final", "search"):
            if (match := re.search(form.format(tag, tag), text, re.S | re.I)) and match[1].strip():
                return tag, match[1].strip()
    return None, ""


def size(text: str | None) -> int:
    """Tokens of a text, about."""
    return max(1, len(text or "") // 2)


def first_of(*groups: Iterable[str], most: int) -> str:
    return " ".join(list(dict.fromkeys(t for g in groups for t in g))[:most])


def doubts(answer: str, question: str, kind: str, least: int, uncertain: list[str], tails: list[str]) -> str:
    """As `functions.text.low_confidence`, of one answer."""
    text, low, asked = answer.strip(), answer.strip().lower(), question.strip()
    if not text:
        return "empty"
    digit = re.search("[0-9]", text) is not None
    tests = [
        (len(text) < least, "short_answer"),
        (any(u in low for u in uncertain if u), "uncertainty_marker"),
        (low.endswith(tuple(tails)), "truncated_tail"),
        (kind == "paragraph_id" and not re.search(r"(?i)\bparagraph\s*[0-9]+\b", text) and not re.search(r"第\s*[0-9]+\s*段", text), "paragraph_id_missing"),
        (kind == "entity_short" and len(text) > 220, "entity_too_long"),
        (kind == "count" and not digit, "count_missing_number"),
        ((asked.lower().startswith("how many") or asked.startswith("多少")) and not digit, "count_missing_number"),
    ]
    return ";".join(name for hit, name in tests if hit)


class Chunks:
    """A sample's chunks and their lexical search."""

    def __init__(self, chunks: list[dict]):
        self.all = sorted(({**c, "text": c["text"] or ""} for c in chunks), key=lambda c: c["chunk_id"] or "")
        self.bags = [self._bag(c["text"]) for c in self.all]
        self.norms = [sum(v * v for v in b.values()) for b in self.bags]

    @staticmethod
    def _bag(text: str) -> Counter:
        low = text.strip().lower()
        return Counter(t for t in (low.split(" ") if " " in low else low) if t.strip())

    def search(self, query: str, k: int) -> list[dict]:
        """The k best chunks with their scores; equal ones in order of their ids. At least one, if there is any."""
        bag = self._bag(query)
        own = sum(v * v for v in bag.values())

        def score(i: int) -> float:
            norm = own * self.norms[i]
            return round(sum(min(n, self.bags[i][t]) for t, n in bag.items()) / sqrt(norm), 6) if norm else 0.0

        rated = [(score(i), i) for i in range(len(self.all))]
        best = sorted(rated, key=lambda r: (-r[0], r[1]))[: max(1, k)]
        return [{**self.all[i], "score": s} for s, i in best]


@dataclass
class Memory:
    """Chunks found and facts taken from them, within a budget of tokens."""

    budget: int
    by_support: bool
    chunks: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)

    def add(self, hits: list[dict], facts: int) -> tuple[list[str], list[str]]:
        """Takes in hits and the first ``facts`` facts of those with text; the ids that are new, and those dropped for them."""
        held = {c["chunk_id"] for c in self.chunks}
        fresh = [h["chunk_id"] for h in hits if h["chunk_id"] and h["chunk_id"] not in held]
        self.chunks += [h for h in {h["chunk_id"]: h for h in reversed(hits) if h["chunk_id"] not in held}.values()][::-1]
        told = [h for h in hits if h["text"].strip()][: max(0, facts)]
        self.facts += [{"content": h["text"].strip()[:80], "doc_id": h.get("doc_id") or "", "chunk_id": h["chunk_id"]} for h in told]
        return fresh, self.prune()

    def prune(self) -> list[str]:
        """Drops chunks while over the budget: the one on which fewest facts rest, then of the lowest score, then the oldest; or just the oldest."""
        resting = Counter(f["chunk_id"] for f in self.facts)
        worth = (lambda c: (resting[c["chunk_id"]], c["score"])) if self.by_support else (lambda c: ())
        used = sum(size(c["text"]) for c in self.chunks) + sum(size(f["content"]) for f in self.facts)
        dropped = []
        while self.chunks and used > self.budget:
            worst = min(range(len(self.chunks)), key=lambda i: (worth(self.chunks[i]), i))
            gone = self.chunks.pop(worst)
            used -= size(gone["text"])
            dropped.append(gone["chunk_id"])
        return dropped

    def evidence(self) -> str:
        return "\n".join(c["text"].strip() for c in self.chunks)

    def overlap(self, question: str) -> float:
        """Share of the question's distinct tokens that the chunks have."""
        asked = set(tokens(question))
        return len(asked & set(tokens(self.evidence()))) / len(asked) if asked else 0.0

    def answer(self, question: str, kind: str, most: int) -> str:
        """As `memory.best_answers`: by kind from the best chunk, else from the first that yields, else a beginning."""
        if not self.chunks:
            return NOT_ENOUGH
        most = max(_LEAST_ANSWER, most)
        keys = tokens(question)
        best = max(range(len(self.chunks)), key=lambda i: (sum(t in self.chunks[i]["text"].lower() for t in keys), -i))
        texts = [self.chunks[best]["text"], *(c["text"] for c in self.chunks)]
        if kind == "count":
            found = next(filter(None, map(_number, texts)), "")
        elif kind == "paragraph_id":
            label = "段落" if re.search("[一-鿿]", question) else "Paragraph "
            found = next((label + n for n in map(_paragraph, texts) if n), "")
        else:
            found = _entity(texts[0], min(48, most)) if kind == "entity_short" else ""
        return found or _cut(texts[0].strip(), most) or NOT_ENOUGH


def _number(text: str) -> str:
    found = _NUMBER.search(text)
    return found[0].replace(",", "").removesuffix(".0") if found else ""


def _paragraph(text: str) -> str:
    return next((m[1] for m in (p.search(text) for p in _PARAGRAPHS) if m), "")


def _cut(text: str, most: int) -> str:
    return text if len(text) <= most else text[:most].rstrip(" ,:;：；")


def _entity(text: str, most: int) -> str:
    first = re.split(r"[\n。！？!?]", text.strip())[0].strip() or text.strip()
    return _cut(first.strip(" \"'`:,;：；"), most)


class Loop:
    """One sample's run: what it has found, counted and spent."""

    def __init__(self, row: dict, model: Model, limits: Limits):
        self.row, self.model, self.limits, self.rules = row, model, limits, limits.of(row["task"])
        self.question, self.kind = row["question"] or "", row["kind"]
        self.index = Chunks(row["chunks"])
        self.memory = Memory(limits.prompt_tokens, limits.memory == "fact_memory")
        self.found = self.retrievals = self.spent = self.said = self.errors = 0
        self.keyword, self.same, self.no_new, self.rewrites, self.forced = "", 0, 0, 0, 0
        self.keywords: list[str] = []
        self.steps: list[dict] = []

    # -- what the loop does --------------------------------------------------

    def fallback(self) -> str:
        return self.memory.answer(self.question, self.kind, 64 if self.row["task"] == SINGLE else 96)

    def ask(self, step: int, repair_of: str | None = None, refine: bool = False) -> str:
        evidence, limits = self.memory.evidence(), self.limits
        if refine:
            prompt = prompts.text(prompts.BASELINE, self.question, prompts.evidence_text(self.memory.chunks))
        elif repair_of is not None:
            prompt = prompts.text(prompts.REPAIR, repair_of, self.question, prompts.evidence_text(self.memory.chunks))
        else:
            facts = prompts.facts_text(self.memory.facts, limits.facts) if self.memory.by_support else ""
            note = f"budget_tokens={sum(size(c['text']) for c in self.memory.chunks) + sum(size(f['content']) for f in self.memory.facts)}"
            prompt = prompts.text(prompts.AGENT, step, self.row["max_steps"], limits.memory, self.question, prompts.evidence_text(self.memory.chunks), facts, note)
        self.spent += size(prompt)
        if hasattr(self.model, "generate"):
            how = (limits.refine.temperature, limits.refine.max_tokens) if refine else (self.row["temperature"], self.row["max_tokens"])
            raw = self.model.generate(prompt, not refine, *how)
        else:
            raw = self.model(self.question, evidence, step, self.row["max_steps"], refine or repair_of is not None)
        self.said += size(raw)
        return raw or ""

    def retrieve(self, query: str, k: int) -> tuple[list[str], list[str], list[str]]:
        """Ids found, new and dropped. A search without new chunks counts against the run."""
        hits = self.index.search(query, k)
        self.retrievals += 1
        self.found += len(hits)
        fresh, dropped = self.memory.add(hits, self.limits.facts)
        self.no_new = 0 if fresh else self.no_new + 1
        return [h["chunk_id"] for h in hits], fresh, dropped

    def note_keyword(self, keyword: str) -> str:
        plain = " ".join(keyword.strip().lower().split())
        self.same = self.same + 1 if plain and plain == self.keyword else 1
        self.keyword = plain
        self.keywords.append(plain)
        return plain

    def reasons(self, step: int) -> list[str]:
        stop = self.limits.stop
        if not stop.enable:
            return []
        tests = [
            (self.same >= stop.same_keyword, f"same_keyword_hits>={stop.same_keyword}"),
            (self.no_new >= stop.no_new, f"no_new_chunk_steps>={stop.no_new}"),
            (self.row["shortcut"] and self.row["task"] == SINGLE and step >= stop.shortcut_step, f"single_doc_shortcut_step>={stop.shortcut_step}"),
        ]
        return [name for hit, name in tests if hit]

    def may_rewrite(self, step: int) -> bool:
        stop, several = self.limits.stop, self.row["task"] == MULTI
        allowed = stop.rewrite if not several or self.rules.rewrite is None else self.rules.rewrite
        no_new, same = self.no_new >= stop.no_new, self.same >= stop.same_keyword
        due = no_new if several and stop.rewrite_needs_no_new else no_new or same
        return allowed and due and not self.rewrites and (not several or step > 1)

    # -- one step -------------------------------------------------------------

    def protocol(self, step: int, info: dict) -> tuple[str, str]:
        """The model's tag and content; repaired if it has none, else from the evidence."""
        try:
            raw = self.ask(step)
        except Exception:
            self.errors += 1
            info["model_failed"] = True
            raw = f"<final>{self.fallback()}</final>"
            self.said += size(raw)
        tag, content = parsed(raw)
        while tag is None and info["repairs"] < self.limits.repairs:
            try:
                raw = self.ask(step, raw)
            except Exception:
                self.errors += 1
                break
            info["repairs"] += 1
            tag, content = parsed(raw)
        if tag is None:
            self.errors += 1
            info["repair_failed"] = True
            tag, content = "final", self.fallback()
        return tag, content

    def search(self, step: int, content: str, info: dict) -> str | None:
        """A search, perhaps a second one in other words; an answer if the run should stop."""
        keyword = content.strip() or self.question
        plain, k = self.note_keyword(keyword), self.row["top_k_iter"]
        info["keyword"] = keyword
        info["hits"], info["fresh"], info["dropped"] = self.retrieve(keyword, k)
        why = self.reasons(step)
        if why and self.may_rewrite(step):
            again = first_of(tokens(self.question), tokens(keyword), most=10) or keyword.strip() or self.question
            if " ".join(again.lower().split()) not in ("", plain):
                self.rewrites += 1
                info["rewritten"] = again
                hits, fresh, dropped = self.retrieve(again, k)
                self.note_keyword(again)
                info["hits"], info["fresh"], info["dropped"] = info["hits"] + hits, info["fresh"] + fresh, info["dropped"] + dropped
                why = self.reasons(step)
        info["same_keyword"], info["no_new"] = self.same, self.no_new
        info["overlap"] = self.memory.overlap(self.question)
        if not why:
            return None
        info["stop"] = ";".join(why)
        return self.fallback()

    def final(self, step: int, content: str, info: dict) -> str | None:
        """The answer, or a forced search instead of a first one that the evidence hardly supports."""
        answer, own, overlap = content.strip() or self.fallback(), self.rules, self.memory.overlap(self.question)
        single, fast = self.row["task"] == SINGLE, self.row["fast"]
        if own.doubt.enable:
            least = self.limits.fast.least if fast else own.doubt.least
            info["doubt"] = doubts(answer, self.question, self.kind if single else "open_text", least, own.doubt.uncertain, own.doubt.tails)
        hit = bool(info["doubt"]) or own.forced.any_final
        if fast:
            hit = overlap < self.limits.fast.low_overlap
        elif single and self.limits.forced_needs_low_overlap:
            hit = hit and overlap < self.limits.low_overlap
        info["overlap"] = overlap
        if step == 1 and hit and self.row["forced"] and self.forced < own.forced.most:
            self.forced += 1
            info["forced"] = first_of(tokens(self.question), most=8) or answer or self.question
            info["hits"], info["fresh"], info["dropped"] = self.retrieve(info["forced"], own.forced.top_k)
            info["overlap"] = self.memory.overlap(self.question)
            return None
        return answer

    def run(self) -> dict:
        if self.index.all:
            hits = self.index.search(self.question, self.row["top_k"])
            self.retrievals, self.found = 1, len(hits)
            self.memory.add(hits, 0)
        answer, reason = None, "max_steps"
        for step in range(1, self.row["max_steps"] + 1):
            info = dict(step=step, keyword="", hits=[], fresh=[], same_keyword=self.same, no_new=self.no_new, rewritten="", forced="", repairs=0, repair_failed=False, model_failed=False, doubt="", overlap=0.0, dropped=[], stop="")
            info["tag"], info["content"] = self.protocol(step, info)
            answer = (self.search if info["tag"] == "search" else self.final)(step, info["content"], info)
            self.steps.append(info)
            if answer is not None:
                reason = info["stop"] or ("model_error" if info["model_failed"] else "no_protocol" if info["repair_failed"] else "final")
                break
        answer = answer or self.fallback()
        return {
            "id": self.row["id"], "task": self.row["task"], "question": self.row["question"], "kind": self.kind, "raw": answer, "refined": self.refined(), "n_steps": len(self.steps), "n_retrieval": self.retrievals, "chunks_total": self.found,
            "prompt_tokens": self.spent, "completion_tokens": self.said, "error_count": self.errors, "stop_reason": reason, "keywords": self.keywords, "steps": self.steps,
        }

    def refined(self) -> str | None:
        """A second answer to a doubtful first one, or null."""
        how, last = self.limits.refine, self.steps[-1] if self.steps else None
        if not self.row["refine"] or last is None:
            return None
        due = how.always or (how.repair_failed and last["repair_failed"]) or (how.doubtful and last["doubt"]) or (how.forced_final and last["stop"])
        if not due:
            return None
        try:
            raw = self.ask(len(self.steps), refine=True)
        except Exception:
            self.errors += 1
            return None
        tag, content = parsed(raw)
        return (content if tag else raw.strip()) or None


def run_one(row: dict, model: Model, limits: Limits) -> dict:
    """The loop over one sample; a model that fails costs an error and an answer from the evidence."""
    return Loop(row, model, limits).run()


def run_in_time(row: dict, model: Model, limits: Limits, running: list | None = None) -> dict:
    """The loop with a limit of seconds per sample, 0 for none; beyond it an answer from the evidence.

    ``running`` lists this worker's loops that went over their time: while one of them still
    runs, the next sample waits for it, up to its own limit, before it starts another.
    """
    if limits.timeout_s <= 0:
        return run_one(row, model, limits)
    running = [] if running is None else running
    for old in list(running):
        old.join(limits.timeout_s)
        if not old.is_alive():
            running.remove(old)
    done: list[dict] = []
    worker = threading.Thread(target=lambda: done.append(run_one(row, model, limits)), daemon=True)
    if not running:
        worker.start()
        worker.join(limits.timeout_s)
        if worker.is_alive():
            running.append(worker)
    if done:
        return done[0]
    loop = Loop(row, model, limits)
    asked = dict.fromkeys(tokens(loop.question))
    by_hits = sorted(loop.index.all, key=lambda c: (-sum(t in c["text"].lower() for t in asked), -len(c["text"]), c["chunk_id"] or ""))
    loop.memory.add([{**c, "score": 0.0} for c in by_hits[: row["top_k"]]], 0)
    return {
        "id": row["id"], "task": row["task"], "question": row["question"], "kind": row["kind"], "raw": loop.fallback(), "refined": None, "n_steps": 1, "n_retrieval": int(bool(by_hits)), "chunks_total": len(loop.memory.chunks),
        "prompt_tokens": 0, "completion_tokens": 0, "error_count": 1, "stop_reason": "timeout", "keywords": [], "steps": [],
    }


def run(samples: DataFrame, chunks: DataFrame, model: Model = mock_model, limits: Limits | None = None) -> DataFrame:
    """One result per sample (id, task, question, documents) over its own chunks (sample_id, chunk_id, doc_id, text).

    Samples without chunks are answered with a fixed text. Chunks of unknown samples are
    ignored: a shared pool belongs to no sample and should be retrieved from first. A row
    holds one sample's chunks. Repeated ids run each on their own.
    """
    ship_package(samples.sparkSession)
    limits = limits or Limits()
    length = F.aggregate("documents", F.lit(0).cast("long"), lambda a, e: a + F.length(F.coalesce(e["text"], F.lit(""))))
    planned = policy(samples.select("id", "task", "question", F.coalesce(length, F.lit(0)).alias("context_chars")), limits)
    doc = F.col("doc_id") if "doc_id" in chunks.columns else F.lit("").alias("doc_id")
    own = chunks.select(F.col("sample_id").alias("id"), F.struct("chunk_id", doc, "text").alias("c"))
    wanted = spread_join(own, samples.select("id").distinct(), "id", hot_values(own, "id"), "leftsemi")  # a pool's chunks leave here
    grouped = wanted.groupBy("id").agg(F.collect_list("c").alias("chunks"))
    rows = planned.join(grouped, "id", "left").select("id", "task", "question", *COLUMNS, "chunks")
    # a model takes far longer than moving a row: as many parts as there are cores, not as the rows' size suggests
    rows = rows.repartition(max(samples.sparkSession.sparkContext.defaultParallelism, int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "id")

    def loop(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        late: list = []
        for batch in batches:
            done = [run_in_time({**r, "chunks": list(r["chunks"]) if r["chunks"] is not None else []}, model, limits, late) for r in batch.astype(object).where(batch.notna(), None).to_dict("records")]
            yield pd.DataFrame(done, columns=[c.split(" ")[0] for c in _FIELDS.split(", ")] + ["steps"])

    return finished(rows.mapInPandas(loop, RESULT), limits)


def finished(results: DataFrame, limits: Limits) -> DataFrame:
    """Adds pred: of one document cleaned prose, typed by its kind, and of a refined answer again; else shortened as the task says, and code as code."""
    how = limits.compact
    question = F.col("question")
    typed = lambda c: T.typed_answer(answers.prose(c), F.col("kind"))
    first = typed(F.col("raw"))
    if how.enable and how.single:
        first = answers.compact(first, question, how.most)
    single = F.coalesce(typed(F.col("refined")), first)
    other = F.col("raw")
    for task, own in limits.tasks.items():
        mode = own.compact
        if task != SINGLE and how.enable and how.entity and mode not in ("off", "none", "disabled"):
            bold = mode in ("aggressive", "entity_compact")
            other = F.when(F.col("task") == task, answers.compact(F.col("raw"), question, how.most, bold, bold, bold or mode == "balanced")).otherwise(other)
    if how.enable and how.code:
        other = F.when(F.col("task") == "code_qa", answers.code(other, how.most)).otherwise(other)
    pred = F.when(F.col("task") == SINGLE, F.when(F.col("refined").isNotNull(), single).otherwise(first)).otherwise(other)
    return results.withColumn("pred", pred)


def trace(results: DataFrame) -> DataFrame:
    """One row per step of each result."""
    return results.select("id", F.explode("steps").alias("s")).select("id", "s.*")


def roll_up(results: DataFrame) -> DataFrame:
    """Per result: whether it searched, rewrote, was forced or repaired, its distinct keywords in order, its last tag and what stopped it."""
    last = F.try_element_at("steps", F.lit(-1))
    ever = lambda test: F.exists("steps", test)
    return results.select(
        "id", ever(lambda s: s["tag"] == "search").alias("searched"), ever(lambda s: s["rewritten"] != "").alias("rewrote"), ever(lambda s: s["forced"] != "").alias("forced"), ever(lambda s: s["repairs"] > 0).alias("repaired"),
        F.array_distinct("keywords").alias("keywords"), last["tag"].alias("last_tag"), last["doubt"].alias("last_doubt"), "stop_reason",
    )


def as_config(limits: Limits) -> dict:
    """The configuration as plain nested values, as it is stored beside a run."""
    return asdict(limits)
