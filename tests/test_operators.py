"""Edge cases: empty tables, single rows, ties, nulls, repeated rows and clashing columns."""

import random

import pytest

from loomspan.operators import memory, ops, retrieve, sampling, stats, validate
from loomspan.operators.metrics import summary
from pyspark.sql import functions as F


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_first_wins_drops_blank_keys(spark):
    df = frame(spark, [("a", 2), ("a", 1), (None, 0), (" ", 0), ("b", 5)], "id string, n int")
    assert {(r.id, r.n) for r in sampling.first_wins(df, "id", F.col("n")).collect()} == {("a", 1), ("b", 5)}


@pytest.mark.parametrize("target", [0, 1, 7, 50])
def test_quotas_add_up(spark, target):
    caps = {"a": 1, "b": 3, "c": 10, "d": 10}
    got = {r.key: r.quota for r in sampling.quotas(frame(spark, list(caps.items()), "key string, cap long"), target).collect()}
    assert sum(got.values()) == min(target, sum(caps.values()))
    assert all(got[k] <= caps[k] for k in caps)


def test_splits_of_small_groups(spark):
    rows = [(f"{g}{i}", g) for g, n in (("a", 1), ("b", 2), ("c", 3), ("d", 20)) for i in range(n)]
    df = frame(spark, rows, "id string, g string")
    three = {(r.g, r.split): r["count"] for r in sampling.three_way(df, "g", "id").groupBy("g", "split").count().collect()}
    assert three == {("a", "test"): 1, ("b", "train"): 1, ("b", "test"): 1, ("c", "train"): 1, ("c", "valid"): 1, ("c", "test"): 1, ("d", "train"): 16, ("d", "valid"): 2, ("d", "test"): 2}
    two = {(r.g, r.split): r["count"] for r in sampling.two_way(df, "g", "id", 0.1).groupBy("g", "split").count().collect()}
    assert two == {("a", "train"): 1, ("b", "train"): 1, ("b", "valid"): 1, ("c", "train"): 2, ("c", "valid"): 1, ("d", "train"): 18, ("d", "valid"): 2}


def test_slices(spark):
    df = frame(spark, [(i,) for i in range(10)], "i int")
    assert sorted(r.i for r in sampling.slice_rows(df, [F.col("i")], 3, 6).collect()) == [3, 4, 5]
    with pytest.raises(ValueError):
        sampling.slice_rows(df, [F.col("i")], 6, 3)


def test_pruning_equals_the_loop(spark):
    rng = random.Random(1)
    rows = [(f"s{s}", f"c{p}", p, rng.randint(1, 50), rng.randint(0, 2), float(rng.randint(0, 2))) for s in range(20) for p in range(rng.randint(1, 9))]
    df = frame(spark, rows, "sample_id string, chunk_id string, pos int, tokens int, support int, score double")
    got = {(r.sample_id, r.chunk_id) for r in memory.pruned(df, 100).where("dropped").collect()}
    want = set()
    for s in {r[0] for r in rows}:
        kept = sorted([r for r in rows if r[0] == s], key=lambda r: (r[4], r[5], r[2]))
        while kept and sum(r[3] for r in kept) > 100:
            want.add((s, kept.pop(0)[1]))
    assert got == want


def test_lexical_keeps_zero_scores_and_breaks_ties_by_key(spark):
    queries = frame(spark, [("q", "s", "alpha beta")], "qid string, sample_id string, question string")
    chunks = frame(spark, [("s", "c3", "gamma delta"), ("s", "c2", "alpha x"), ("s", "c1", "alpha x"), ("t", "c0", "alpha beta"), ("s", "c4", None)], "sample_id string, chunk_id string, text string")
    got = [(r.chunk_id, r.score) for r in retrieve.lexical_top_k(queries, chunks, 4).orderBy("rank").collect()]
    assert got == [("c1", 0.5), ("c2", 0.5), ("c3", 0.0), ("c4", 0.0)]
    assert retrieve.lexical_top_k(queries, chunks.limit(0)).count() == 0


def test_dense_in_blocks(spark, monkeypatch):
    rows = [(i, [float(i % 3), 1.0]) for i in range(12)] + [(12, None), (13, [1.0])]
    df = frame(spark, rows, "vec_id long, embedding array<float>")
    whole = {tuple(r) for r in retrieve.dense_top_k(df, df.where("vec_id < 5"), 2).collect()}
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 2)
    assert {tuple(r) for r in retrieve.dense_top_k(df, df.where("vec_id < 5"), 2).collect()} == whole
    assert len(whole) == 10


def test_fusion_of_a_missing_list(spark):
    lexical = frame(spark, [("q", "c1", 1.0)], "qid string, chunk_id string, score double")
    got = retrieve.fused(lexical.limit(0), lexical).first()
    assert (got.score_dense, got.score_lexical, round(got.score, 6)) == (0.5, 1.0, 0.675)


def test_intervals_of_one_value(spark):
    got = stats.intervals(frame(spark, [("a", 1.0), ("b", 1.0), ("b", 3.0)], "m string, value double"), "m").orderBy("m").collect()
    assert (got[0].std, got[0].ci95_low, got[0].ci95_high) == (0.0, 1.0, 1.0)
    assert (got[1].ci95_low, got[1].ci95_high) == (-10.706, 14.706)


def test_summary_of_nothing(spark, data_dir):
    empty = spark.read.parquet(f"{data_dir}/baseline_rag.parquet").limit(0).withColumns({"em": F.lit(0.0), "f1": F.lit(0.0)})
    row = summary(empty).first()
    assert (row.n_samples, row.f1, row.p95_latency_ms, row.backend_mode) == (0, 0.0, 0.0, "unknown")


def test_gate_needs_every_mean(spark):
    df = frame(spark, [(0.1, 1.0, 1.0), (0.0, 9.0, 1.0), (None, 1.0, 1.0)], "delta_f1 double, p95_ratio double, retrieval_ratio double")
    assert [(r.passed, r.reason) for r in stats.gate(df).collect()] == [(True, ""), (False, "delta_f1;p95_ratio"), (False, "missing_metric")]


def test_validation_raises(spark):
    df = frame(spark, [("a", "single_doc_qa", "q", [("d", "t")], "x"), ("b", None, "", [], None)], "id string, task string, question string, documents array<struct<doc_id:string,text:string>>, answer string")
    found = validate.sample_violations(df)
    assert [r.violations for r in found.orderBy("id").collect()] == ["", "task;question;documents;answer"]
    with pytest.raises(Exception, match="invalid record b"):
        validate.require_valid(found).collect()
    with pytest.raises(ValueError):
        validate.require_count(df, 3)
    with pytest.raises(ValueError):
        validate.require_disjoint(df, df)


def test_config_is_flattened(spark):
    old = ops.config_frame(spark, {"a": {"b": 1, "c": list(range(20))}, "d": [1, 2]})
    new = ops.config_frame(spark, {"a": {"b": 2, "c": list(range(20))}, "e": "x"})
    assert {(r.key, r.old, r.new) for r in stats.changed(old, new).collect()} == {("a.b", "1", "2"), ("d", "[1, 2]", None), ("e", None, "x")}


def test_shards(spark):
    plan = ops.shard_plan(frame(spark, [("m", 400), ("none", 0)], "method string, total long"))
    assert [(r.start, r.end, r.expected) for r in plan.orderBy("shard").collect()] == [(0, 170, 170), (170, 340, 170), (340, 400, 60)]
    done = frame(spark, [("m", 0, 170, 9), ("m", 1, 5, 1), ("m", 2, 0, 3)], "method string, shard long, out_lines long, attempts long")
    assert [r.status for r in ops.shard_status(plan, done).orderBy("shard").collect()] == ["completed", "retry_pending", "failed"]


def test_ranks_equal_one_window(spark):
    rng = random.Random(8)
    numbers = rng.sample(range(1_000_000), 300)
    df = frame(spark, [("hot" if i % 3 else "cold", n) for i, n in enumerate(numbers)] + [("hot", None)], "g string, n long")
    got = {(r.g, r.n): r["rank"] for r in sampling.ranks(df, "g", "n", 1000).collect()}
    want = {}
    for g in ("hot", "cold"):
        own = sorted(n for i, n in enumerate(numbers) if ("hot" if i % 3 else "cold") == g)
        want |= {(g, n): i + 1 for i, n in enumerate(own)}
    assert got == want


def test_limited_lines(spark):
    df = frame(spark, [(f"k{i}",) for i in range(5)], "key string")
    assert [r.line for r in ops.limited(df, "key", 3).collect()] == ["k0", "k1", "k2", "... and 2 more"]
    assert ops.limited(df, "key", 9).count() == 5
