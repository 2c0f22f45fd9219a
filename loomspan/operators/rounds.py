"""Rounds of a tuned configuration: edits of one factor, what each round's result leads to, and reports.

Rounds are few and each depends on the last: a group's are folded in order within one row.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from copy import deepcopy

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: By failure mode the setting that is changed, its default, the step and the bound.
FACTORS: dict[str, tuple[str, int, int, int]] = {
    "single_doc_recall": ("agent.task_overrides.single_doc_qa.top_k_init", 3, 1, 5),
    "tail_latency": ("agent.decoding_budget.default_max_new_tokens", 160, -16, 128),
    "multi_doc_recall": ("agent.task_overrides.multi_doc_qa.top_k_iter", 1, 1, 2),
    "code_recall": ("agent.task_overrides.code_qa.top_k_init", 2, 1, 4),
    "oom_guard": ("agent.decoding_budget.task_caps.multi_doc_qa", 176, -16, 144),
    "slow_plateau": ("retrieval.hybrid.max_candidates", 10, -1, 8),
}
#: Fixed value: what is changed where a plateau's setting is at its bound.
AFTER_PLATEAU = ("agent.early_stop.single_doc_max_steps", 2, 1, 3)


def setting(config: Mapping, key: str, default=None):
    """A dotted key's value."""
    at = config
    for name in key.split("."):
        if not isinstance(at, Mapping) or name not in at:
            return default
        at = at[name]
    return at


def edited(config: Mapping, changes: Mapping[str, object]) -> dict:
    """A copy of a nested configuration with dotted keys set; the original stays as it is."""
    out = deepcopy(dict(config))
    for key, value in changes.items():
        *above, last = key.split(".")
        at = out
        for name in above:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        at[last] = value
    return out


def one_factor(config: Mapping, mode: str) -> tuple[dict, str]:
    """A configuration with the one setting moved that a failure mode calls for, within its bound, and what was done."""

    def moved(factor: tuple[str, int, int, int]) -> tuple[str, int, int]:
        key, default, step, bound = factor
        old = setting(config, key)
        old = int(old) if isinstance(old, (int, float)) else default
        return key, old, min(bound, old + step) if step > 0 else max(bound, old + step)

    key, old, new = moved(FACTORS.get(mode, FACTORS["slow_plateau"]))
    if mode not in FACTORS or mode == "slow_plateau":
        if old == new:
            key, old, new = moved(AFTER_PLATEAU)
    return edited(config, {key: new}), f"{key} {old}->{new}"


def derived(base: Mapping, variants: Mapping[str, Mapping[str, object]]) -> dict[str, dict]:
    """A configuration per variant: the base with that variant's dotted keys."""
    return {name: edited(base, changes) for name, changes in variants.items()}


def controlled(rounds: DataFrame, by: str, least_gain: float = 0.002, drop: float = 0.03, passes: int = 2, idle: int = 2) -> DataFrame:
    """``by, round, score, best_score, improved, rollback, idle, passes, prior, decision`` of each round, in order.

    ``rounds`` has by, round, score and passed (of a promoted round's gate; null of one not
    promoted). The best score moves by ``least_gain`` or more at once. A round that is no
    gain and ``drop`` below the best is rolled back; ``passes`` passed rounds in a row call
    for a confirmation, ``idle`` rounds without gain in a row for a stop; prior is the round before.
    """
    state = "struct<round:bigint,score:double,best_score:double,improved:boolean,rollback:boolean,idle:int,passes:int,prior:bigint>"
    first = F.lit(None).cast(state)

    def step(last, r):
        best = F.coalesce(last["best_score"], F.lit(-1e9))
        improved = r["score"] - best >= least_gain
        rollback = ~improved & (r["score"] < best - drop)
        passed = ~rollback & F.coalesce(r["passed"], F.lit(False))
        return F.struct(
            r["round"].cast("long").alias("round"), r["score"].cast("double").alias("score"), F.when(improved, r["score"]).otherwise(best).cast("double").alias("best_score"), improved.alias("improved"), rollback.alias("rollback"),
            F.when(improved, 0).otherwise(F.coalesce(last["idle"], F.lit(0)) + 1).cast("int").alias("idle"), F.when(passed, F.coalesce(last["passes"], F.lit(0)) + 1).otherwise(0).cast("int").alias("passes"), last["round"].cast("long").alias("prior"),
        ).cast(state)

    listed = F.array_sort(F.collect_list(F.struct("round", F.col("score").cast("double").alias("score"), "passed")))
    folded = F.aggregate("l", F.array().cast(f"array<{state}>"), lambda out, r: F.concat(out, F.array(step(F.when(F.size(out) > 0, F.try_element_at(out, F.lit(-1))).otherwise(first), r))))
    rows = rounds.where(F.col("score").isNotNull()).groupBy(by).agg(listed.alias("l")).select(by, F.explode(folded).alias("s")).select(by, "s.*")
    decision = F.when(F.col("rollback"), "rollback").when(F.col("passes") >= passes, "confirm").when(F.col("idle") >= idle, "stop").when(F.col("passes") > 0, "keep").otherwise("edit")
    return rows.withColumn("decision", decision)


def round_report(controlled_rounds: DataFrame, by: str) -> DataFrame:
    """``by, report``: one fixed line per round, in order."""
    line = F.format_string("round %d: score %.4f, best %.4f, %s", "round", "score", "best_score", "decision")
    listed = F.array_sort(F.collect_list(F.struct("round", line.alias("l"))))
    return controlled_rounds.groupBy(by).agg(listed.alias("x")).select(by, F.array_join(F.transform("x", lambda s: s["l"]), "\n").alias("report"))


def required(paths: list[str], services: Mapping[str, Callable[[], bool]] | None = None) -> None:
    """Fails before a run, naming every missing or empty file and every service that doesn't answer."""
    missing = [p for p in paths if not os.path.exists(p) or (os.path.isfile(p) and os.path.getsize(p) == 0)]

    def answers(ask: Callable[[], bool]) -> bool:
        try:
            return bool(ask())
        except Exception:
            return False

    silent = [name for name, ask in (services or {}).items() if not answers(ask)]
    if missing or silent:
        raise FileNotFoundError("; ".join([*(f"missing {p}" for p in missing), *(f"no answer from {s}" for s in silent)]))


def anchored(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A result that is made once: read if it is whole, else built and written."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def only_one(lock: str) -> Iterator[None]:
    """Holds a lock file while a driver runs; a second one fails."""
    try:
        handle = os.open(lock, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"another run holds {lock}") from None
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(lock)


def logged(events: DataFrame, path: str) -> None:
    """Appends a guardian's events (what was missing, what was done, when) to its log."""
    events.write.mode("append").json(path)


def remedies(wanted: DataFrame, running: DataFrame, at: str) -> DataFrame:
    """``name, action, at``: of wanted processes (name, done) those to start again: neither done nor running (name)."""
    left = wanted.where(~F.coalesce("done", F.lit(False))).join(running.select("name").distinct(), "name", "left_anti")
    return left.select("name", F.lit("restart").alias("action"), F.lit(at).cast("timestamp").alias("at"))
