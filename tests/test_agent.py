"""The loop against traces worked by hand, its policy, its models and the baseline."""

import time

import pytest
from loomspan.operators import agent, models
from loomspan.operators import policy as P
from loomspan.plans import runs
from pyspark.sql import functions as F

CHUNKS = [{"chunk_id": f"c{i}", "doc_id": "d", "text": t} for i, t in enumerate(["nothing here at all, really nothing.", "Ada measured alpha beta near gamma.", "delta came later, in 1944.", "epsilon never came."])]


def row(**over):
    own = dict(id="s", task="open", question="who measured alpha beta near gamma", kind="open_text", fast=False, generic=False, long=False, top_k=1, top_k_iter=1, max_steps=4, temperature=0.2, max_tokens=64, shortcut=False, refine=False, forced=False, chunks=CHUNKS)
    return own | over


def script(*outputs):
    """A model that says one thing after the other, and the last one for ever."""
    said = []

    def model(question, evidence, step, max_steps, repair):
        said.append((step, repair, evidence))
        out = outputs[min(len(said), len(outputs)) - 1]
        if out is None:
            raise RuntimeError
        return out

    model.said = said
    return model


def go(model, limits=None, **over):
    return agent.run_one(row(**over), model, limits or P.Limits())


def test_answers_from_evidence():
    got = go(models.mock_model)
    assert (got["raw"], got["stop_reason"], got["n_steps"], got["n_retrieval"]) == ("Ada measured alpha beta near gamma.", "final", 1, 1)


def test_a_search_and_an_answer():
    got = go(script("<search>delta came</search>", "<final>in 1944</final>"))
    first, second = got["steps"]
    assert (first["hits"], first["fresh"], first["no_new"], first["same_keyword"]) == (["c2"], ["c2"], 0, 1)
    assert (second["tag"], got["raw"], got["n_retrieval"], got["chunks_total"], got["keywords"]) == ("final", "in 1944", 2, 2, ["delta came"])


def test_a_rewrite_starts_the_counters_again():
    # step 1: alpha finds c1 again; step 2: again, so both counters are at two. The rewrite's words find c1 too: no_new is three, same one
    got = go(script("<search>alpha beta</search>"))
    assert [s["rewritten"] for s in got["steps"]] == ["", "who measured alpha beta near gamma"]
    assert got["steps"][1]["same_keyword"] == 1 and got["steps"][1]["no_new"] == 3
    assert got["stop_reason"] == "no_new_chunk_steps>=2" and got["n_retrieval"] == 4 and got["raw"].startswith("Ada")
    # a rewrite that finds something lets the run go on, once
    got = go(script("<search>zeta eta</search>"), question="epsilon never", top_k=1)
    assert got["steps"][0]["fresh"] == ["c0"] and got["steps"][1]["rewritten"] == "epsilon never zeta eta"
    assert got["stop_reason"] in ("same_keyword_hits>=2;no_new_chunk_steps>=2", "no_new_chunk_steps>=2") and sum(s["rewritten"] != "" for s in got["steps"]) == 1


def test_several_documents_rewrite_late_and_only_without_new_chunks():
    limits = P.Limits(stop=P.EarlyStop(no_new=1, same_keyword=9))
    got = go(script("<search>alpha beta</search>"), limits, task=P.MULTI)
    assert got["n_steps"] == 1 and got["steps"][0]["rewritten"] == "" and got["stop_reason"] == "no_new_chunk_steps>=1"
    limits = P.Limits(stop=P.EarlyStop(no_new=9, same_keyword=2))
    assert go(script("<search>alpha beta</search>"), limits, task=P.MULTI)["steps"][1]["rewritten"] == ""
    assert go(script("<search>alpha beta</search>"), limits)["steps"][1]["rewritten"] != ""
    off = P.Limits(stop=P.EarlyStop(no_new=2, same_keyword=9), tasks={P.MULTI: P.TaskRules(rewrite=False)})
    assert go(script("<search>alpha beta</search>"), off, task=P.MULTI)["steps"][1]["rewritten"] == ""


def test_one_document_may_stop_by_its_steps():
    limits = P.Limits(stop=P.EarlyStop(no_new=9, same_keyword=9, shortcut_step=2))
    got = go(script("<search>delta came</search>", "<search>epsilon never</search>"), limits, task=P.SINGLE, shortcut=True)
    assert got["stop_reason"] == "single_doc_shortcut_step>=2" and got["n_steps"] == 2
    assert go(script("<search>delta came</search>", "<search>epsilon never</search>"), P.Limits(stop=P.EarlyStop(enable=False)), max_steps=3)["stop_reason"] == "max_steps"


def forced_limits(**over):
    return P.Limits(tasks={P.SINGLE: P.TaskRules(doubt=P.Doubt(True), forced=P.Forced(True, **over)), P.MULTI: P.TaskRules(doubt=P.Doubt(True), forced=P.Forced(True, **over))}, low_overlap=0.5)


def test_a_doubtful_first_answer_is_searched_for():
    outputs = "<final>short</final>", "<final>a long and certain answer it is</final>"
    got = go(script(*outputs), forced_limits(), task=P.MULTI, forced=True)
    assert [s["forced"] for s in got["steps"]] == ["who measured alpha beta near gamma", ""] and got["steps"][0]["doubt"] == "short_answer"
    assert got["raw"] == "a long and certain answer it is" and got["n_retrieval"] == 2
    # of one document only where the evidence has little of the question
    assert go(script(*outputs), forced_limits(), task=P.SINGLE, forced=True)["raw"] == "short"
    assert go(script(*outputs), forced_limits(), task=P.SINGLE, forced=True, question="zeta eta alpha")["n_retrieval"] == 2
    # the fast path looks at the evidence alone
    assert go(script(*outputs), forced_limits(), task=P.SINGLE, forced=True, fast=True, question="zeta eta")["n_retrieval"] == 2
    assert go(script(*outputs), forced_limits(), task=P.MULTI, forced=False)["raw"] == "short"
    # not after the first step
    assert go(script("<search>delta came</search>", *outputs), forced_limits(), task=P.MULTI, forced=True)["raw"] == "short"
    assert go(script(outputs[1]), forced_limits(any_final=True), task=P.MULTI, forced=True)["n_retrieval"] == 2


def test_failures_cost_errors():
    got = go(script(None))
    assert (got["error_count"], got["stop_reason"]) == (1, "model_error") and got["raw"].startswith("Ada")
    model = script("garbage", "<final>fixed</final>")
    assert go(model)["raw"] == "fixed" and [s[1] for s in model.said] == [False, True]
    got = go(script("garbage"))
    assert (got["error_count"], got["stop_reason"], got["steps"][0]["repairs"]) == (1, "no_protocol", 1)
    assert go(script("garbage", None))["error_count"] == 2
    got = go(models.mock_model, chunks=[])
    assert got["raw"] and got["n_retrieval"] == 3 and got["chunks_total"] == 0  # two searches and a rewrite


def test_memory_drops_what_no_fact_rests_on():
    hits = [{"chunk_id": f"c{i}", "text": "x" * 40, "score": s} for i, s in enumerate((0.5, 0.1, 0.9))]
    held = agent.Memory(10**9, True)
    held.add(hits, 2)
    held.budget = 100
    assert held.prune() == [] and len(held.facts) == 2
    held.budget = 99
    assert held.prune() == ["c2"]  # two facts of 20 tokens, three chunks of 20
    held.budget = 79
    assert held.prune() == ["c1"]
    old = agent.Memory(50, False)
    assert old.add(hits, 0)[1] == ["c0"]
    assert old.add(hits[:1], 0)[0] == ["c0"]  # dropped, so new again


def test_refining_and_time():
    limits = P.Limits(tasks={P.SINGLE: P.TaskRules(doubt=P.Doubt(True))}, refine=P.Refine(True))
    got = go(script("<final>short</final>", "a longer and certain answer here"), limits, task=P.SINGLE, refine=True)
    assert (got["raw"], got["refined"]) == ("short", "a longer and certain answer here")
    assert go(script("<final>a longer and certain answer here</final>"), limits, task=P.SINGLE, refine=True)["refined"] is None
    assert go(script("<final>short</final>", None), limits, task=P.SINGLE, refine=True)["error_count"] == 1
    late: list = []
    slow = P.Limits(timeout_s=0.1)
    for _ in range(3):
        got = agent.run_in_time(row(), lambda *_: time.sleep(1.5) or "<final>x</final>", slow, late)
        assert (got["stop_reason"], got["error_count"]) == ("timeout", 1) and got["raw"].startswith("Ada")
    assert len(late) == 1  # a worker is never left with more than one


def test_run_cleans_answers_by_task(spark):
    samples = spark.createDataFrame([("a", P.SINGLE, "who?", [("d", "t")]), ("b", P.MULTI, "Where?", [("d", "t")]), ("c", "code_qa", "x", [("d", "t")]), ("e", None, None, None)], "id string, task string, question string, documents array<struct<doc_id:string,text:string>>")
    chunks = spark.createDataFrame([("a", "a1", "d", "text"), ("pool", "p1", "d", "text"), ("b", "b1", None, None)], "sample_id string, chunk_id string, doc_id string, text string")
    limits = P.Limits(tasks={P.MULTI: P.TaskRules(compact="aggressive"), "code_qa": P.TaskRules()}, compact=P.Compact(True, 96, entity=True, code=True))
    said = {"who?": "<final>Wait, Ada and</final>", "Where?": "<final>Born in Rome, Italy. Then</final>", "x": "<final>`foo(1)` is it</final>", "": "<final>so</final>"}
    got = {r.id: r for r in agent.run(samples, chunks, lambda q, *_: said[q], limits).collect()}
    assert {k: r.pred for k, r in got.items()} == {"a": "Ada", "b": "Rome, Italy", "c": "foo(1) is it", "e": "so"}
    assert {k: r.n_retrieval for k, r in got.items()} == {"a": 1, "b": 1, "c": 0, "e": 0}
    empty = agent.run(samples.limit(0), chunks, lambda *_: "", limits)
    assert empty.count() == 0 and agent.roll_up(empty).count() == agent.trace(empty).count() == 0


def reply(content, finish="stop", **message):
    return {"choices": [{"message": {"content": content, **message}, "finish_reason": finish}]}


def endpoint(*replies, **over):
    sent = []

    def post(url, body, timeout):
        sent.append((url, body))
        return replies[min(len(sent), len(replies)) - 1]

    return models.Endpoint("http://h/v1/", "m", post=post, **over), sent


def test_endpoint_retries_and_falls_back():
    own, sent = endpoint(reply("", "length"), reply("<final>x</final> more"))
    assert own.generate("p", True, 0.0, 100) == "<final>x</final>"
    assert [s[1]["max_tokens"] for s in sent] == [100, 512] and sent[0][0] == "http://h/v1/chat/completions" and sent[0][1]["top_k"] == 1
    own, _ = endpoint(reply(None, reasoning="so <search>k</search> it"))
    assert own.generate("p", True, 0.5, 10) == "<search>k</search>"
    own, _ = endpoint(reply([{"text": ""}], thinking="one\ntwo"))
    assert own.generate("p", True, 0.5, 10) == "<final>two</final>" and own.generate("p", False, 0.5, 10) == "two"
    own, sent = endpoint(reply("", "length"))
    with pytest.raises(RuntimeError):
        own.generate("p", False, 0.5, 4096)
    assert len(sent) == 1
    own, sent = endpoint(reply([{"text": "a"}, {"text": "b"}]), switches=("/t", "/n"), thinking=True, seed=7)
    assert own.generate("p", False, 0.5, 10) == "a\nb" and own.generate("p", True, 0.5, 10) == "a\nb"
    assert [s[1]["messages"][0]["content"] for s in sent] == ["/t\np", "/n\np"] and sent[0][1]["seed"] == 7
    assert endpoint(reply(""))[0].shortened("<final>" + "y" * 600) == f"<final>{'y' * 512}</final>"


def test_baseline_with_a_model(spark):
    samples = spark.createDataFrame([("a", "who?"), ("b", "fail"), ("c", None)], "id string, question string")
    chunks = spark.createDataFrame([("a", "a1", "who ?"), ("b", "b1", "f" * 200)], "sample_id string, chunk_id string, text string")

    def model(question, evidence, step, max_steps, repair):
        if question == "fail":
            raise RuntimeError
        return f" <final>{evidence}!</final> "

    got = {r.id: r for r in runs.baseline(samples, chunks, model=model).collect()}
    assert (got["a"].pred, got["a"].backend_mode, got["a"].n_retrieval) == ("who ?!", "real", 1)
    assert (got["b"].pred, got["b"].error_count, got["b"].backend_mode) == ("f" * 160, 1, "unknown")
    assert (got["c"].pred, got["c"].n_retrieval, got["c"].retrieved_chunks_total) == ("!", 0, 0)
    with pytest.raises(Exception):
        runs.baseline(samples, chunks, model=model, formal=True).collect()
    assert {r.id: r.pred for r in runs.baseline(samples, chunks).collect()} == {"a": "who", "b": "f" * 200, "c": ""}


def test_policy_defaults(spark):
    df = spark.createDataFrame([("a", None, None, 5), ("x_passage_count_1", P.SINGLE, "q", 5), ("b", P.SINGLE, "Who?", 5)], "id string, task string, question string, context_chars long")
    got = {r.id: r for r in P.policy(df).collect()}
    assert (got["a"].kind, got["a"].max_steps, got["a"].top_k, got["a"].fast) == ("open_text", 6, 3, False)
    assert (got["x_passage_count_1"].kind, got["x_passage_count_1"].max_steps) == ("count", 2) and got["b"].fast
    assert P.policy(df).where(F.col("refine") | F.col("forced") | F.col("long")).count() == 0
