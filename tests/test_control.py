"""Schemas, rounds, documents, archives, pages and single runs."""

import json
import zipfile

import pytest
from loomspan.operators import ops, rounds, sampling, schema, stats
from loomspan.sources import files
from pyspark.sql import functions as F


def run():
    return dict(run_id="r", timestamp_utc="t", git_commit="", config_paths=[], model_info=dict(backend="b", name_or_path="n", quantization="q", n_ctx=1, n_gpu_layers=True), hardware={}, seeds=dict(python=1, numpy=2))


def test_plain_records_are_walked():
    assert schema.problems(run(), schema.SCHEMAS["run_metadata"]) == [".config_paths: fewer than 1 items", ".model_info.n_gpu_layers: not of type integer", ".seeds.torch: missing"]
    fact = dict(fact_id="", type="rumour", content="c", evidence=dict(doc_id="d", chunk_id=3), confidence=1.5)
    assert schema.problems(fact, schema.SCHEMAS["fact"]) == [".fact_id: shorter than 1", ".type: not one of 5 values", ".evidence.chunk_id: not of type string", ".confidence: above 1.0"]
    assert schema.problems([], schema.SCHEMAS["fact"]) == [".: not of type object"]
    with pytest.raises(ValueError, match="run_metadata: .config_paths"):
        schema.require(run(), "run_metadata")


def test_tables_are_walked(spark):
    rows = [("a", "x", [("d", "t"), ("", None)]), (None, "code_qa", None), ("c", "code_qa", []), ("d", "code_qa", [None])]
    df = spark.createDataFrame(rows, "id string, task string, documents array<struct<doc_id:string,text:string>>")
    got = [r.violations for r in schema.violations(df, schema.SCHEMAS["sample"]).collect()]
    lacking = ".question: missing;.answer: missing"
    assert got == [f".task: not one of 3 values;{lacking};.documents[].doc_id: shorter than 1;.documents[].text: missing", f".id: missing;{lacking};.documents: missing", f"{lacking};.documents: fewer than 1 items", f"{lacking};.documents[]: missing"]
    wrong = spark.createDataFrame([(1, {"a": 1}, 2.0)], "fact_id int, evidence map<string,int>, confidence double")
    assert schema.violations(wrong, schema.SCHEMAS["fact"]).first().violations == ".fact_id: not of type string;.type: missing;.content: missing;.confidence: above 1.0"
    assert schema.violations(df.limit(0), schema.SCHEMAS["sample"]).count() == 0


def test_one_factor_is_moved_within_its_bound():
    config = {"agent": {"task_overrides": {"single_doc_qa": {"top_k_init": 4}}, "early_stop": {}}, "retrieval": {"hybrid": {"max_candidates": 8}}}
    new, done = rounds.one_factor(config, "single_doc_recall")
    assert rounds.setting(new, "agent.task_overrides.single_doc_qa.top_k_init") == 5 and done.endswith("4->5") and config["agent"]["task_overrides"]["single_doc_qa"]["top_k_init"] == 4
    assert rounds.one_factor(new, "single_doc_recall")[1].endswith("5->5")
    assert rounds.setting(rounds.one_factor({}, "tail_latency")[0], "agent.decoding_budget.default_max_new_tokens") == 144
    assert rounds.one_factor(config, "slow_plateau")[1] == "agent.early_stop.single_doc_max_steps 2->3"
    assert rounds.one_factor({}, "else")[1] == "retrieval.hybrid.max_candidates 10->9"
    made = rounds.derived(config, {"a": {"x.y": 1}, "b": {"agent": 2}})
    assert made["a"]["x"] == {"y": 1} and made["b"]["agent"] == 2 and "x" not in config


def test_rounds_are_folded_in_order(spark):
    rows = [("r", 1, 0.50, None), ("r", 2, 0.501, True), ("r", 3, 0.52, True), ("r", 4, 0.51, True), ("r", 5, 0.45, True), ("r", 6, None, True), ("q", 1, -1.0, False)]
    df = spark.createDataFrame(rows, "run string, round int, score double, passed boolean").repartition(3)
    got = {(r.run, r.round): (r.best_score, r.improved, r.rollback, r.idle, r.passes, r.prior, r.decision) for r in rounds.controlled(df, "run").collect()}
    assert got == {
        ("r", 1): (0.50, True, False, 0, 0, None, "edit"), ("r", 2): (0.50, False, False, 1, 1, 1, "keep"), ("r", 3): (0.52, True, False, 0, 2, 2, "confirm"), ("r", 4): (0.52, False, False, 1, 3, 3, "confirm"),
        ("r", 5): (0.52, False, True, 2, 0, 4, "rollback"), ("q", 1): (-1.0, True, False, 0, 0, None, "edit"),
    }
    assert rounds.round_report(rounds.controlled(df, "run"), "run").where("run = 'q'").first().report == "round 1: score -1.0000, best -1.0000, edit"


def test_before_and_beside_a_run(spark, tmp_path):
    there, empty = tmp_path / "a", tmp_path / "b"
    there.write_text("x")
    empty.write_text("")
    rounds.required([str(there)], {"s": lambda: True})
    with pytest.raises(FileNotFoundError, match="missing .*b; no answer from s"):
        rounds.required([str(there), str(empty)], {"s": lambda: 1 / 0})
    made = []
    for _ in range(2):
        got = rounds.anchored(spark, str(tmp_path / "anchor"), lambda: made.append(1) or spark.range(3))
        assert got.count() == 3
    assert made == [1]
    with rounds.only_one(str(tmp_path / "lock")):
        with pytest.raises(RuntimeError):
            with rounds.only_one(str(tmp_path / "lock")):
                pass
    with rounds.only_one(str(tmp_path / "lock")):
        pass
    wanted = spark.createDataFrame([("a", True), ("b", None), ("c", False)], "name string, done boolean")
    todo = rounds.remedies(wanted, wanted.where("name = 'c'"), "2026-01-01")
    assert [r.name for r in todo.collect()] == ["b"]
    rounds.logged(todo, str(tmp_path / "log"))
    rounds.logged(todo, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_documents_and_configurations(tmp_path):
    path = str(tmp_path / "x" / "a.json")
    files.write_document(path, {"k": ["ü"]})
    assert files.read_document(path) == {"k": ["ü"]}
    config = str(tmp_path / "y" / "c.yaml")
    files.write_config(config, {"b": {"a": [1, "é"]}, "a": None})
    assert files.read_config(config) == {"b": {"a": [1, "é"]}, "a": None}
    (tmp_path / "empty.yaml").write_text("")
    assert files.read_config(str(tmp_path / "empty.yaml")) == {}
    described = {**run(), "config_paths": [config], "model_info": {**run()["model_info"], "n_gpu_layers": 1}, "seeds": dict(python=1, numpy=2, torch=3)}
    files.snapshot_run(str(tmp_path / "run"), described)
    assert (tmp_path / "run" / "c.yaml").exists() and json.loads((tmp_path / "run" / "run_metadata.json").read_text())["run_id"] == "r"
    with pytest.raises(ValueError):
        files.snapshot_run(str(tmp_path / "run"), run())


def test_archives_and_pages(spark, tmp_path):
    for n in range(2):
        with zipfile.ZipFile(tmp_path / f"{n}.zip", "w") as archive:
            for i in range(5):
                archive.writestr(f"d/{n}{i}.content", f"text {n}{i}")
            archive.writestr("other.txt", "x")
    wanted = spark.createDataFrame([("03",), ("11",), ("99",), ("03",)], "id string")
    assert sorted(tuple(r) for r in files.zip_members(spark, str(tmp_path), wanted).collect()) == [("03", "text 03"), ("11", "text 11")]
    path = str(tmp_path / "rows.json")
    for n in (0, 1, 25, 30):
        files.write_document(path, [{"n": i} for i in range(n)])
        for options in ({}, {"total": n}):
            assert sorted(json.loads(r.row)["n"] for r in files.paged(spark, path=path, page=10, **options).collect()) == list(range(n))
        assert files.paged(spark, path=path, page=10, most=12).count() == min(n, 12)
    lines = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    files.write_lines(lines, str(tmp_path / "lines"))
    assert files.read_lines(spark, str(tmp_path / "lines"), "id string", most=2).count() == 2


def test_states_of_a_shard(spark):
    steps = [("start", 0, 1), ("exit", 50, 2), ("start", 50, 3), ("exit", 60, 4), ("start", 60, 5), ("exit", 99, 6)]
    df = spark.createDataFrame([("m", 0, at, e, 100, n) for e, n, at in steps] + [("m", 1, 1, "start", 100, 7), ("m", 1, 2, "exit", 100, 100), ("m", 2, 1, "start", 100, 100)], "method string, shard long, at long, event string, expected long, out_lines long")
    got = {}
    for r in ops.transitions(df).orderBy("shard", "at").collect():
        got.setdefault(r.shard, []).append((r.was, r.status))
    assert got == {
        0: [("pending", "running"), ("running", "retry_pending"), ("retry_pending", "running"), ("running", "retry_pending"), ("retry_pending", "running"), ("running", "failed")],
        1: [("pending", "retry_pending"), ("retry_pending", "completed")], 2: [("pending", "completed")],
    }


def test_student_summary_and_hits(spark):
    rows = [("t", "a", 1.0, 1.0, 2, (10.0,)), ("t", "b", 0.0, 0.5, 4, None), ("s", "a", 0.0, 0.0, None, (5.0,))]
    df = spark.createDataFrame(rows, "model string, task string, em double, f1 double, n_retrieval int, latency_ms struct<total:double>")
    got = {(r.scope, r.model): r for r in stats.student_summary(df, ["a", "b"], "t").collect()}
    assert (got["key_macro", "t"].f1, got["key_macro", "t"].n_samples, got["key_macro", "t"].delta_f1) == (0.75, 2, 0.0)
    assert (got["a", "s"].delta_f1, got["a", "s"].delta_retrieval, got["a", "s"].delta_latency_ms) == (-1.0, -2.0, -5.0)
    none = {r.model: r for r in stats.student_summary(df, ["zz"], "t").where("scope = 'key_macro'").collect()}
    assert none["s"].n_samples == 0 and none["s"].f1 == 0.0
    searches = spark.createDataFrame([("q1", "x"), ("q2", ""), ("q3", "y"), ("q4", None)], "qid string, gold string")
    found = spark.createDataFrame([("q1", "a x b", 1), ("q1", "y", 2), ("q2", "", 1)], "qid string, text string, rank int")
    assert tuple(stats.keyword_hits(searches, found).first()) == (4, 0.25)
    assert tuple(stats.keyword_hits(searches.limit(0), found).first()) == (0, 0.0)


def test_annotated_parts(spark):
    got = sampling.annotated(spark.range(10), {"a": 2, "b": 3}, [F.col("id").desc()], {"v": F.lit(1)}).orderBy("id").collect()
    assert [(r.id, r.part, r.v) for r in got] == [(5, "b", 1), (6, "b", 1), (7, "b", 1), (8, "a", 1), (9, "a", 1)]
