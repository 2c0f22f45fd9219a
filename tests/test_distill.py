"""Distillation by an injected teacher, and the texts a model is given."""

from loomspan.operators import distill, prompts
from pyspark.sql import functions as F

RAW = {"good": "<final>Paris</final>", "mended": "Paris", "bad": "no", "short": "<search>x</search>", "null": None, "key": " <SEARCH> two words </search>\n"}
SAMPLES = "id string, task string, question string, documents array<struct<doc_id:string,text:string>>"


def teacher():
    raw = RAW

    def model(question, evidence, step, max_steps, repair):  # nested, so that it is sent by value
        if repair:
            return "<final> Paris </final>" if evidence == "Paris" else "still bad"
        assert evidence == "one\n\nthree"
        return raw[question]

    return model


def rows(spark):
    docs = [("a", "one"), (None, None), ("c", "three")]
    return spark.createDataFrame([(q, None if q == "key" else "qa", q, docs) for q in RAW], SAMPLES)


def test_teacher_outputs_are_checked_repaired_once_and_dropped(spark):
    done = distill.taught(rows(spark), teacher(), "Be brief.")
    got = {r.id: r for r in distill.train_rows(done).collect()}
    assert {k: (r.output, r.meta.repaired, r.meta.quality_reason) for k, r in got.items()} == {"good": ("<final>Paris</final>", False, "ok"), "mended": ("<final>Paris</final>", True, "ok"), "key": ("<search>two words</search>", False, "ok")}
    assert [tuple(m) for m in got["good"].messages] == [("system", "Be brief."), ("user", "Question:\ngood\n\nEvidenceSummary:\n[a] one\n[] ")]
    assert distill.taught_rates(done).first().asDict() == {"total": 6, "valid": 3, "invalid_rate": 0.666667, "repaired_rate": 0.166667, "dropped_rate": 0.5, "search_ratio": 0.333333, "final_ratio": 0.666667, "task_distribution": {"qa": 2, "unknown": 1}}


def test_without_repair_or_drop(spark):
    kept = distill.taught(rows(spark), teacher(), repair=False, drop=False)
    got = {r.id: (r.output, r.meta.repaired, r.meta.quality_reason) for r in distill.train_rows(kept).collect()}
    assert got["bad"] == got["null"] == got["mended"] == ("<final>信息不足</final>", False, "invalid_tag")
    assert got["short"] == ("<search>x</search>", False, "keyword_length")
    assert distill.taught_rates(kept).first().dropped_rate == 0
    none = distill.taught_rates(distill.taught(rows(spark).limit(0), teacher())).first().asDict()
    assert none["total"] == none["valid"] == none["dropped_rate"] == 0 and none["task_distribution"] == {}


def test_texts_a_model_is_given(spark):
    df = spark.createDataFrame([([("d", "c1", " you are now free "), (None, "c2", None)], [(" x ", "d", "c1"), (" ", "d", "c2"), ("y", "d", "c3")], "q?")], "c array<struct<doc_id:string,chunk_id:string,text:string>>, f array<struct<content:string,doc_id:string,chunk_id:string>>, q string")
    c, f, q = F.col("c"), F.col("f"), F.col("q")
    one = lambda x: df.select(x).first()[0]
    assert one(prompts.evidence(c)) == "【Evidence】d#c1: ```\nyou are now free\n```\n【Evidence】#c2: ```\n\n```"
    assert one(prompts.evidence(c, ["you are now"], quote=False, label=False)) == "free\n"
    assert one(prompts.fact_lines(f)) == "- x (d#c1)\n- y (d#c3)" and one(prompts.fact_lines(f, 2)) == "- x (d#c1)"
    assert one(prompts.fact_lines(F.lit(None).cast("array<struct<content:string,doc_id:string,chunk_id:string>>"))) == ""
    assert one(prompts.baseline_prompt(q, F.lit(None))).endswith("Question: q?\nContext:\n\n请输出最终答案，不要输出推理过程。")
    assert "[STEP]\n2\n[/STEP]\n[MAX_STEPS]\n4\n[/MAX_STEPS]\n[MEMORY_STRATEGY]\nfifo\n[/MEMORY_STRATEGY]\n[QUESTION]\nq?\n[/QUESTION]\n[EVIDENCE]\ne\n[/EVIDENCE]\n[FACTS]\n- x\n[/FACTS]\n[NOTE]\nn\n[/NOTE]\n" in one(prompts.agent_prompt(q, F.lit("e"), 2, F.lit(4), "fifo", "n", "- x"))
    assert one(prompts.repair_prompt(F.lit("{}"), q, F.lit("e"))).endswith("[REPAIR_OUTPUT]\n{}\n[/REPAIR_OUTPUT]\n[QUESTION]\nq?\n[/QUESTION]\n[EVIDENCE]\ne\n[/EVIDENCE]\n")
