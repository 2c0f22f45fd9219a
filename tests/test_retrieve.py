"""Searches within a scope and over all chunks against plain loops."""

import random
from collections import Counter
from math import sqrt

import pytest
from loomspan.operators import retrieve

WORDS = "alpha beta gamma delta epsilon zeta eta theta 河 流".split()


def bag(text):
    low = (text or "").strip().lower()
    return Counter(t for t in (low.split(" ") if " " in low else low) if t.strip())


def score(q, c):
    a, b = bag(q), bag(c)
    norm = sum(v * v for v in a.values()) * sum(v * v for v in b.values())
    return round(sum(min(n, b[t]) for t, n in a.items()) / sqrt(norm), 6) if norm else 0.0


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    queries = [(f"q{i}", f"s{i % 4}", text(4)) for i in range(9)] + [("null", "s0", None), ("lone", "s9", "alpha beta")]
    chunks = [(f"c{i}", f"s{i % 4}" if i % 3 else "pool", text(rng.randint(1, 12))) for i in range(60)] + [("cn", "s0", None), ("ce", "s0", ""), ("zh", "s1", "河流河")]
    return queries, chunks, spark.createDataFrame(queries, "qid string, sample_id string, question string"), spark.createDataFrame(chunks, "chunk_id string, sample_id string, text string")


def best(rated, k):
    return [(c, s) for s, c in sorted(rated, key=lambda r: (-r[0], r[1]))[:k]]


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append((r.chunk_id, r.score))
    return out


def test_lexical_search_in_a_scope(tables):
    queries, chunks, q, c = tables
    got = found(retrieve.search("lexical", q, c, 5))
    want = {i: best([(score(t, x), n) for n, s, x in chunks if s == own], 5) for i, own, t in queries}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("block", [4096, 4])
def test_lexical_search_over_all_chunks_in_blocks(tables, monkeypatch, block):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    queries, chunks, q, c = tables
    got = found(retrieve.search("lexical", q.select("qid", "question"), c, 7, scope=None))
    want = {i: [r for r in best([(score(t, x), n) for n, _, x in chunks], 7) if r[1] > 0] for i, _, t in queries}
    assert got == {k: v for k, v in want.items() if v}


@pytest.mark.parametrize("block", [4096, 3])
def test_dense_search_is_exact_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", block)
    rng = random.Random(5)
    rows = [(i, [float(rng.randint(-3, 3)) for _ in range(4)]) for i in range(40)] + [(40, None), (41, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    got = {}
    for r in retrieve.dense_top_k(df, df.where("vec_id % 5 = 0 and vec_id < 40"), 3).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.vec_id, r.score))
    whole = [(i, v) for i, v in rows if v and len(v) == 4]
    assert got == {i: best([(round(sum(a * b for a, b in zip(v, w)), 6), j) for j, w in whole if j != i], 3) for i, v in whole if i % 5 == 0}


def test_hybrid_search_alike_in_one_scope_and_over_all(tables, spark):
    queries, chunks, q, c = tables
    one = spark.createDataFrame([(n, "s", x) for n, _, x in chunks], "chunk_id string, sample_id string, text string")
    asked = spark.createDataFrame([(i, "s", t) for i, _, t in queries], "qid string, sample_id string, question string")
    for mode in ("dense", "hybrid", "lexical"):
        scoped, every = found(retrieve.search(mode, asked, one, 4)), found(retrieve.search(mode, asked.drop("sample_id"), one, 4, scope=None))
        assert {k: [r for r in v if r[1] > 0] for k, v in scoped.items() if any(r[1] > 0 for r in v)} == every


def test_a_missing_index_falls_back_or_fails(tables):
    _, _, q, c = tables
    plain = found(retrieve.search("lexical", q, c, 1))
    assert found(retrieve.search("other", q, c, 0)) == found(retrieve.search("dense", q, c, 1, built=("lexical",))) == plain
    with pytest.raises(ValueError, match="dense"):
        retrieve.search("dense", q, c, formal=True, built=("lexical",))
    for scope in ("sample_id", None):
        assert retrieve.search("hybrid", q.limit(0), c, scope=scope).count() == retrieve.search("lexical", q, c.limit(0), scope=scope).count() == 0
