"""Registered queries over whole small tables against brute force."""

import re
from collections import defaultdict

import pytest

from loomspan.llm import leaks, pieces, queries


def core(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


def windows(t, k):
    return {t[i : i + k] for i in range(len(t) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def shingles(t, n=5):
    words = re.findall(r"[㐀-鿿豈-﫿぀-ヿ]|[^\W_㐀-鿿豈-﫿぀-ヿ]+", (t or "").lower())
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


@pytest.fixture(scope="module")
def records(spark, data_dir):
    out = {}
    for r in spark.read.parquet(f"{data_dir}/minilongbench_tiny.parquet").collect():
        for e in r.documents or []:
            out["minilongbench_tiny", f"{r.id}_{e.doc_id}"] = e.text
    for r in spark.read.parquet(f"{data_dir}/corpus_chunks.parquet").collect():
        out["corpus_chunks", r.chunk_id] = r.text
    return out


def test_near_duplicates(spark, data_dir, records):
    known = {k: windows(core(t), 8) for k, t in records.items() if len(core(t)) >= 100}
    keys = sorted(known)
    want = {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and jaccard(known[a], known[b]) >= 0.6}
    assert {tuple(r) for r in queries.p1_found(spark, data_dir).collect()} == want


def test_groups(spark, data_dir, records):
    known = {k: shingles(t) for k, t in records.items() if core(t)}
    got = {(r.source_table, r.key): r for r in queries.p1_groups(spark, data_dir).collect()}
    assert set(got) == {k for k in known if known[k]}
    keys = sorted(got)
    classes = defaultdict(set)
    for k in keys:
        classes[k[0], got[k].class_id].add(k)
    first = {c: known[min(ks)] for c, ks in classes.items()}
    assert all(known[k] == first[k[0], got[k].class_id] for k in keys)
    names = sorted(first)
    linked = defaultdict(set)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if a[0] == b[0] and jaccard(first[a], first[b]) >= 0.8:
                linked[a].add(b)
                linked[b].add(a)
    for k in keys:
        own = k[0], got[k].class_id
        assert got[k].n_links == len(linked[own])
        assert all(got[min(classes[other])].group_id == got[k].group_id for other in linked[own])


def test_pieces(spark, data_dir):
    texts = {}
    for r in spark.read.parquet(f"{data_dir}/minilongbench_tiny.parquet").collect():
        for e in r.documents or []:
            texts["minilongbench_tiny", r.id, e.doc_id] = (e.text, 0, 1200)
    for r in spark.read.parquet(f"{data_dir}/corpus_chunks.parquet").collect():
        texts["corpus_chunks", r.sample_id, r.chunk_id] = (r.text, r.offset_start or 0, 512)
    got = defaultdict(list)
    for r in queries.p2_pieces(spark, data_dir).collect():
        got[r.source_table, r.sample_id, r.item_id].append(r)
    assert {k for k, (t, _, m) in texts.items() if t and len(t) > m} == set(got)
    for k, rows in got.items():
        text, base, limit = texts[k]
        rows.sort(key=lambda r: r.piece)
        assert [r.piece for r in rows] == list(range(len(rows)))
        assert rows[0].offset_start == base and rows[-1].offset_end == base + len(text) and rows[-1].kind == "end"
        for before, r in zip(rows, rows[1:]):
            assert 0 <= r.overlap == before.offset_end - r.offset_start <= 64
        for r in rows:
            assert 0 < r.offset_end - r.offset_start <= limit
            end = r.offset_end - base
            marks = [c.isspace() or c in pieces.PUNCTUATION for c in text[max(0, end - 1) : end + 1]]
            assert r.kind == "end" or any(marks) == (r.kind == "natural")


def overlapping(spark, data_dir):
    texts, asked = defaultdict(list), {}
    for r in sorted(spark.read.parquet(f"{data_dir}/minilongbench_tiny.parquet").collect(), key=lambda r: r.prepared_at):
        texts[r.id] += [windows(core(e.text), 8) for e in r.documents or [] if len(core(e.text)) >= 100]
        asked[r.id] = windows(core(r.question), 3), (r.meta or {}).get("dataset")
    split = lambda i: re.search(r"_(train|valid|test)_\d+$", i)
    train = [i for i in asked if split(i) and split(i)[1] == "train"]
    held = [i for i in asked if split(i) and split(i)[1] != "train"]
    return {(a, b) for a in train for b in held if jaccard(asked[a][0], asked[b][0]) >= 0.5 and any(jaccard(x, y) >= 0.6 for x in texts[a] for y in texts[b])}, held, split


def test_cross_split_overlaps_and_report(spark, data_dir):
    want, held, split = overlapping(spark, data_dir)
    assert {tuple(r) for r in queries.p3_found(spark, data_dir).collect()} == {tuple(sorted(p)) for p in want}
    rows = queries.p3_report(spark, data_dir).collect()
    for s in ("valid", "test"):
        own = [r for r in rows if r.split == s]
        assert sum(r.n_samples for r in own) == sum(split(i)[1] == s for i in held)
        assert sum(r.n_pairs for r in own) == sum(split(b)[1] == s for _, b in want)
        assert sum(r.n_overlapping for r in own) == len({b for _, b in want if split(b)[1] == s})


def test_defects_agree_with_found(spark, data_dir):
    every = defaultdict(set)
    for r in queries.p5_defects(spark, data_dir).collect():
        every[r.source_table, r.id].add(r.defect)
    found = {(r.source_table, r.id): r.defect for r in queries.p5_found(spark, data_dir).collect()}
    assert set(found) == set(every) and all(found[k] in every[k] for k in found)
    student = {r.id: r.output for r in spark.read.parquet(f"{data_dir}/student_train.parquet").collect()}
    bare = {i for i, o in student.items() if not core(re.sub(r"(?is)</?(final|search)>", "", o or ""))}
    assert {i for (t, i), d in found.items() if t == "student_train" and d == "empty"} >= bare


def test_leaks(spark, data_dir):
    docs = {r.doc_id: core(r.text) for r in spark.read.parquet(f"{data_dir}/documents.parquet").collect()}
    parts = [(r.item_id, p, leaks._least(r.lang), core(r[p])) for r in spark.read.parquet(f"{data_dir}/eval_items.parquet").collect() for p in ("passage", "question")]
    inside = {k: {d: windows(t, k) for d, t in docs.items()} for k in (leaks.LEAST, leaks.LEAST_ZH)}
    want = {(d, i, p) for i, p, k, t in parts for w in [windows(t, k)] if w for d in docs if not w.isdisjoint(inside[k][d])}
    measured = {(r.doc_id, r.item_id, r.part): r for r in leaks.leaks(spark.read.parquet(f"{data_dir}/documents.parquet"), spark.read.parquet(f"{data_dir}/eval_items.parquet")).collect()}
    assert set(measured) == want
    assert {tuple(r) for r in queries.p7_found(spark, data_dir).collect()} == {(d, i) for d, i, _ in want}
    assert {(r.doc_id, r.item_id, r.part) for r in queries.p7_leaks(spark, data_dir).collect()} == {k for k, r in measured.items() if r.covered / r.size >= queries.LEAST_COVERAGE}
