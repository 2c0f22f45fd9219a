"""Corpus operators against brute force on small fixtures with all kinds of dirt."""

import random
import tempfile
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomspan.llm import cores, crosssplit, leaks, neardup, pieces, queries, sketch, subjects

WORDS = "amber basin cedar delta ember fjord glade haven inlet jetty knoll lagoon meadow nook orchard prairie quarry ridge summit tundra 河流 森林 高山 湖泊".split()


def text(rng, n=60):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 99)) for _ in range(n))


def edited(rng, t, times):
    words = t.split(" ")
    for _ in range(times):
        words[rng.randrange(len(words))] = rng.choice(WORDS)
    return " ".join(words)


def shingles(t, k):
    c = "".join(ch for ch in (t or "").lower() if ch.isalnum())
    return {c[i : i + k] for i in range(len(c) - k + 1)}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 0.0


def records():
    rng = random.Random(7)
    rows = [("g", "null", None), ("g", "empty", ""), ("g", "blank", " \n"), ("g", "short", "tiny"), ("g", None, text(rng))]
    for i in range(25):
        t = text(rng)
        rows += [("g", f"a{i}", t), ("g", f"b{i}", edited(rng, t, i)), ("h", f"a{i}", t)]
    rows += [("g", f"same{i}", rows[-3][2].upper() + "!") for i in range(4)] + [rows[5]] * 3
    long = text(rng, 20_000)
    return rows + [("g", "long1", long), ("g", "long2", long + " more")]


def test_near_pairs_equal_brute_force(spark):
    rows = records()
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "grp string, key string, text string, cid int, band string")
    got = {tuple(r) for r in queries.every_pair(df, 0.6, 8, 100, 0).collect()}
    known = {(g, k): shingles(t, 8) for g, k, t in rows if k and t and len(shingles(t, 1) and "".join(ch for ch in t.lower() if ch.isalnum())) >= 100}
    keys = sorted(known)
    want = {(a[0], a[1], b[1]) for i, a in enumerate(keys) for b in keys[i + 1 :] if a[0] == b[0] and jaccard(known[a], known[b]) >= 0.6}
    assert got == want
    assert queries.every_pair(df.limit(0), 0.6, 8, 100, 0).count() == 0


def test_near_groups_have_one_row_per_record(spark):
    rows = records()
    df = spark.createDataFrame(rows, "grp string, key string, text string")
    got = {(r.grp, r.key): r for r in neardup.near_groups(df, 0.8, words=5, least=1).collect()}
    assert set(got) == {(g, k) for g, k, t in rows if k and t and any(c.isalnum() for c in t)}
    assert got["g", "same0"].class_id == got["g", "same3"].class_id
    assert got["g", "a1"].group_id == got["g", "b1"].group_id != got["g", "a2"].group_id
    assert got["h", "a1"].group_id != got["g", "a1"].group_id
    assert got["g", "short"].n_links == 0
    assert len(got["g", "short"].class_id) == 32


def test_groups_of_a_long_common_name_keep_apart(spark):
    t, name = text(random.Random(1)), "g" * 70
    df = spark.createDataFrame([(name + "1", "a", t), (name + "1", "b", t + " one"), (name + "2", "c", t), (None, "d", t), ("", "e", t)], "grp string, key string, text string")
    assert [tuple(r) for r in queries.every_pair(df, 0.6, 8, 100, 0).collect()] == [(name + "1", "a", "b")]
    assert len({r.group_id for r in neardup.near_groups(df).collect()}) == 4


@pytest.mark.parametrize("threshold", [0.6, 0.8, 0.9])
def test_small_sets_share_an_exact_key_at_the_threshold(threshold):
    rng = np.random.default_rng(5)
    for _ in range(3000):
        n = int(rng.integers(1, sketch.SMALL + 1))
        pool = rng.integers(0, 2**63, 2 * n + 4, dtype=np.uint64)
        a = np.unique(pool[:n])
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.95], pool[n : n + int(rng.integers(0, n // 3 + 2))]]))
        if cores.overlap(a, b) >= threshold:
            rows = [set(zip(*(x.tolist() for x in sketch.exact_keys(s, threshold)))) for s in (a, b)]
            assert any(k == l and (s == 0 or s != t) for k, s in rows[0] for l, t in rows[1])


def test_many_short_texts_meet_few_others(spark):
    rng = random.Random(6)
    rows = [("g", str(i), " ".join(f"w{rng.randrange(30_000)}" for _ in range(rng.randint(1, 9)))) for i in range(20_000)]
    rows += [("g", f"s{i}", f"subscribe to our free daily letter n{i}") for i in range(5000)]
    df = spark.createDataFrame(rows, "grp string, key string, text string").repartition(4)
    drawn = neardup.sketches(df, 0.8, words=5, least=1)
    assert drawn.count() == drawn.select("handle").distinct().count()
    assert neardup.candidates(drawn, 0.8).count() < 25_000
    long = [("h", str(i), " ".join(f"w{rng.randrange(99)}" for _ in range(n)) + " x" * (i % 2)) for n in (7, 8, 9, 30, 47, 50, 58) for i in range(2)]
    pairs = [("h", f"{i}{side}", " ".join(f"w{(7 * i + j) % 61}" for j in range(n + side))) for i, n in enumerate((5, 8, 9, 12, 24, 48, 50, 60)) for side in (0, 1)]
    got = {tuple(r)[1:] for r in queries.every_pair(spark.createDataFrame(pairs + long, "grp string, key string, text string"), 0.8, words=5, least=1).collect()}
    known = {k: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for _, k, t in pairs + long for w in [t.split()]}
    keys = sorted(known)
    assert got == {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if jaccard(known[a], known[b]) >= 0.8} and got


def test_a_hot_band_is_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "BLOCK", 500)
    rng = np.random.default_rng(8)
    regs = rng.integers(0, 6000, (5000, sketch.REGISTERS)).astype(np.uint16)
    regs[:, : sketch.ROWS] = 7
    regs[1] = regs[0]
    handles = rng.integers(-(2**60), 2**60, 5000) * 4
    df = spark.createDataFrame([(int(h), 0, 100, r.tobytes(), b"", b"") for h, r in zip(handles, regs)], neardup._SKETCH)
    rows = neardup.placed(df, 0.6)
    assert rows.groupBy("key").count().agg({"count": "max"}).first()[0] < 3 * 500
    assert rows.where("(handle & 3) > 0").select("key").distinct().count() > 20
    a, b = sorted(handles[:2].tolist())
    assert [tuple(r) for r in neardup.candidates(df, 0.9).collect()] == [(a, b)]
    monkeypatch.setattr(sketch, "least_agreeing", lambda threshold: 0)
    assert neardup.candidates(df, 0.6).count() == 5000 * 4999 // 2


def test_components_equal_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)]
    root = {n: n for e in edges for n in e}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    got = {r.node: r.root for r in neardup.connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    loops = {n for n in root if find(n) == n and all(find(m) != n for m in root if m != n)}
    assert got == {n: find(n) for n in root if n not in loops}


def test_estimates_follow_the_similarity():
    rng = np.random.default_rng(1)
    for share in (0.2, 0.6, 0.9):
        both = rng.integers(0, 2**63, int(2000 * share), dtype=np.uint64)
        parts = [np.concatenate([both, rng.integers(0, 2**63, (2000 - len(both)) // 2, dtype=np.uint64)]) for _ in range(2)]
        owner = np.repeat([0, 1], [len(p) for p in parts])
        regs = sketch.registers(np.concatenate(parts), owner, 2)
        assert abs(sketch.estimates(regs[:1], regs[1:])[0] - share) < 0.15


@given(st.text(st.sampled_from("ab c,。\nx"), max_size=400), st.integers(2, 60), st.integers(0, 40))
@settings(max_examples=200, deadline=None)
def test_pieces_cover_the_text_within_the_limit(t, limit, overlap):
    if overlap >= limit:
        with pytest.raises(ValueError):
            pieces.cut(t, limit, overlap)
        return
    starts, ends, kinds = pieces.cut(t, limit, overlap)
    if not t:
        assert starts == []
        return
    assert starts[0] == 0 and ends[-1] == len(t) and kinds[-1] == "end"
    assert all(0 < e - s <= limit for s, e in zip(starts, ends))
    assert all(a <= e and e - a <= overlap for a, e in zip(starts[1:], ends)) and all(x < y for x, y in zip(ends, ends[1:]))
    marks = {i + d for i, c in enumerate(t) if c.isspace() or c in pieces.PUNCTUATION for d in (0, 1)}
    assert all((e in marks) == (k == "natural") for e, k in zip(ends[:-1], kinds[:-1]))
    stretch = max((len(x) for x in "".join("\0" if c.isspace() or c in pieces.PUNCTUATION else c for c in t).split("\0")), default=0)
    assert ("forced" in kinds) == (stretch > limit and len(t) > limit)


@pytest.mark.parametrize("limit, overlap", [(1200, 64), (512, 51)])
def test_a_last_stretch_within_the_limit_is_not_forced(limit, overlap):
    for head in ("word " * 300, ", "):
        for n in (limit - overlap - 1, limit - overlap, limit - overlap + 1, limit - 1, limit, limit + 1):
            t = head + "x" * n
            starts, ends, kinds = pieces.cut(t, limit, overlap)
            assert ("forced" in kinds) == (n > limit)
            assert starts[0] == 0 and ends[-1] == len(t) and all(0 < e - s <= limit for s, e in zip(starts, ends))
            assert all(0 <= e - a <= overlap for a, e in zip(starts[1:], ends))


def test_short_texts_are_forced_only_by_a_stretch_over_the_limit():
    assert pieces.cut(", ab", 3, 2)[2] == ["natural", "end"]
    for n in range(1, 11):
        for bits in range(1 << n):
            t = "".join("a,"[bits >> i & 1] for i in range(n))
            for limit in (2, 3, 4, 5):
                for overlap in range(limit):
                    starts, ends, kinds = pieces.cut(t, limit, overlap)
                    assert ("forced" in kinds) == (max(map(len, t.split(","))) > limit), (t, limit, overlap)
                    assert starts[0] == 0 and ends[-1] == n and all(0 < e - s <= limit for s, e in zip(starts, ends))
                    assert all(0 <= e - a <= overlap for a, e in zip(starts[1:], ends)), (t, limit, overlap)


def test_pieces_tell_their_overlap(spark):
    df = spark.createDataFrame([("a", "word " * 500, 1000), ("b", "x" * 2500, 1000), ("c", "short", 1000)], "item_id string, text string, limit int").withColumn("size", F.lit(None).cast("int"))
    rows = pieces.exploded(pieces.pieces(df)).orderBy("item_id", "piece").collect()
    for before, r in zip([None, *rows], rows):
        assert r.overlap == (0 if r.piece == 0 else before.piece_end - r.piece_start)
    assert {r.item_id for r in rows} == {"a", "b"} and all(r.overlap <= 64 for r in rows)


def test_an_edit_changes_only_pieces_near_it():
    rng = random.Random(5)
    t = text(rng, 3000)
    changed = t[:9000] + "an inserted phrase, " + t[9000:]
    before = {t[s:e] for s, e in zip(*pieces.cut(t, 800, 50)[:2])}
    after = {changed[s:e] for s, e in zip(*pieces.cut(changed, 800, 50)[:2])}
    assert len(after - before) <= 0.4 * len(after)


def samples(rng):
    rows = []
    for i in range(30):
        t, q = text(rng, 40), text(rng, 8)
        rows.append((f"lb_x_{i:09d}_train_{i}", q, [("d1", text(rng, 30)), ("d2", t)], "extra"))
        if i % 3 == 0:
            rows.append((f"lb_x_{i:09d}_test_{i}", edited(rng, q, i % 4), [("d1", edited(rng, t, i // 2))], "extra"))
        if i % 7 == 0:
            rows.append((f"lb_y_{i:09d}_valid_{i}", text(rng, 8), [("d1", t)], "extra"))
    rows += [("lb_z_000000001_valid_1", None, [("d1", rows[0][2][1][1])], None), ("lb_z_000000002_test_1", rows[0][1], None, None), ("lb_z_000000003_test_1", rows[0][1], [("d1", None), ("d2", "")], None), (None, "q", [], None), ("odd", rows[0][1], rows[0][2], None)]
    return rows + [rows[0], rows[1]]


@pytest.mark.parametrize("indexed", [True, False])
def test_cross_split_overlaps_equal_brute_force(spark, indexed):
    rows = samples(random.Random(11))
    df = spark.createDataFrame(rows, "id string, question string, documents array<struct<doc_id:string,text:string>>, split string")
    got = {tuple(r) for r in crosssplit.overlaps(df.drop("split"), most_indexed=crosssplit.MOST_INDEXED if indexed else -1).collect()}

    def docs(r):
        return [shingles(e[1], 8) for e in r[2] or [] if len("".join(c for c in (e[1] or "") if c.isalnum())) >= 100]

    train = {r[0]: r for r in rows if r[0] and "_train_" in r[0]}
    held = {r[0]: r for r in rows if r[0] and ("_test_" in r[0] or "_valid_" in r[0])}
    want = {(a, b) for a, x in train.items() for b, y in held.items() if jaccard(shingles(x[1], 3), shingles(y[1], 3)) >= 0.5 and any(jaccard(s, t) >= 0.6 for s in docs(x) for t in docs(y))}
    assert got == want and want
    assert crosssplit.overlaps(df.limit(0)).count() == 0
    assert sum(r.n_pairs for r in crosssplit.report(spark.createDataFrame(sorted(got), "train_id string, held_id string"), spark.createDataFrame([(k, "s") for k in held], "id string, source string")).collect()) == len(got)


@pytest.mark.parametrize("direct", [0, crosssplit.DIRECT])
def test_cross_split_overlaps_are_the_same_in_blocks(spark, direct):
    rng = random.Random(5)
    rows = samples(random.Random(11))
    asked, t = "What does this function do?", text(rng, 40)
    rows += [(f"c_{i}_{s}_{i}", asked, [("d1", edited(rng, t, 4 * i))], "extra") for i in range(9) for s in ("train", "valid")]
    df = spark.createDataFrame(rows, "id string, question string, documents array<struct<doc_id:string,text:string>>, split string").drop("split")
    got = sorted(map(tuple, crosssplit.overlaps(df).collect()))
    assert len(got) == len(set(got)) and any(a.startswith("c_") for a, _ in got)
    assert sorted(map(tuple, crosssplit.overlaps(df, most_indexed=-1, most_asked=-1, most_compared=-1, direct=direct).collect())) == got


def test_cross_split_overlaps_shuffle_less_than_the_texts(spark):
    rng = random.Random(17)
    rows = []
    for i in range(40):
        q, t = text(rng, 8), text(rng, 1200)
        rows += [(f"x_{i}_{s}_{i}", q, [("d", edited(rng, t, 9))]) for s in ("train", "test")]
    df = spark.createDataFrame(rows, "id string, question string, documents array<struct<doc_id:string,text:string>>").repartition(4)
    df.write.mode("overwrite").parquet(folder := tempfile.mkdtemp() + "/t")
    sc = spark.sparkContext._jsc.sc()

    def written():
        sc.listenerBus().waitUntilEmpty()
        executors = sc.statusStore().executorList(False)
        return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))

    before = written()
    assert crosssplit.overlaps(spark.read.parquet(folder), most_indexed=-1).count() == 40
    assert written() - before < sum(len(d[0][1]) for _, _, d in rows)


def test_the_question_last_prepared_counts(spark):
    rng = random.Random(3)
    t, q = text(rng, 40), text(rng, 8)
    other = text(rng, 8)
    rows = [("x_1_train_1", q, 1), ("x_1_train_1", "zz " + other, 2), ("x_1_test_1", q, 1), ("x_2_test_2", other, 1)]
    df = spark.createDataFrame([(i, asked, [("d", t)], at) for i, asked, at in rows], "id string, question string, documents array<struct<doc_id:string,text:string>>, at int")
    df = df.withColumn("prepared_at", F.timestamp_seconds("at"))
    assert [tuple(r) for r in crosssplit.overlaps(df).collect()] == [("x_1_train_1", "x_2_test_2")]


def longest_common(a, b):
    best = 0
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0] * (len(b) + 1)
        for j, y in enumerate(b):
            if x == y:
                new[j + 1] = row[j] + 1
                best = max(best, new[j + 1])
        row = new
    return best


@pytest.mark.parametrize("most", [leaks.MOST_BROADCAST, 0])
def test_leaks_equal_brute_force(spark, most):
    rng = random.Random(2)
    items = [(i, "zh" if i % 4 == 0 else "en", text(rng, 12), text(rng, 25), "a") for i in range(12)] + [(50, "en", None, None, None), (51, None, "", "short", None)]
    docs = [(0, None, 1), (1, "", 1), (2, text(rng, 30), 1)]
    for i in range(3, 20):
        p = items[i % 12][3]
        at = rng.randint(0, 100)
        docs.append((i, text(rng, 10) + " - ".join([p[at : at + rng.randint(10, 120)], text(rng, 5)]), 1))
    docs += [(30, items[1][2].upper() + "?", 1), (30, items[1][2], 2), (31, " ".join(reversed(items[2][3].split(" ", 12))), 1)]
    d, e = spark.createDataFrame(docs, "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, lang string, question string, passage string, answer string")
    got = {(r.doc_id, r.item_id, r.part): r for r in leaks.leaks(d, e, most).collect()}
    want = {}
    for k, t, _ in docs:
        for i, lang, q, p, _ in items:
            for part, s in (("question", q), ("passage", p)):
                n = longest_common(cores.core_text(s), cores.core_text(t))
                if n >= (20 if lang == "zh" else 50):
                    want[k, i, part] = max(n, want.get((k, i, part), 0))
    assert set(got) == set(want)
    assert all(r.longest <= want[k] and r.covered <= r.size for k, r in got.items())
    assert leaks.leaks(d, e.limit(0), most).count() == leaks.leaks(d.limit(0), e, most).count() == 0


@given(st.text(st.sampled_from("ab"), max_size=80), st.text(st.sampled_from("ab"), max_size=80))
@settings(max_examples=300, deadline=None)
def test_tiles_by_length_cover_what_tiles_by_run_do(x, y):
    a, b = cores.code_points(x + y[:20]), cores.code_points(y + x[5:30])
    found = [leaks.tiles(a, b, 4), leaks.tiles(a, b, 4, most=0)]
    for tiled in found:
        for start in (0, 1):
            places = [i for t in tiled for i in range(t[start], t[start] + t[2])]
            assert len(places) == len(set(places))
        assert all(np.array_equal(a[p : p + n], b[q : q + n]) for p, q, n in tiled)
    assert [max((t[2] for t in tiled), default=0) for tiled in found] == [max((t[2] for t in found[0]), default=0)] * 2


@pytest.mark.parametrize("unit", ["a", "ab", "abcde"])
def test_repetitive_texts_are_tiled_in_linear_time(unit):
    points = cores.code_points((unit * 100_000)[:100_000])
    began = time.monotonic()
    assert leaks.tiles(points, points, 20) == [(0, 0, 100_000)]
    assert time.monotonic() - began < 1


def test_coverage_decides_which_leaks_are_kept(spark):
    rng = random.Random(10)
    whole = text(rng, 60)
    words = whole.split(" ")
    mixed = " ".join(" ".join(words[i : i + 12]) + " zz" for i in (48, 0, 24, 12, 36))
    docs = [(1, whole), (2, mixed), (3, "x " + " ".join(words[:12]))]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    e = spark.createDataFrame([(1, "en", None, whole)], "item_id long, lang string, question string, passage string")
    measured = leaks.leaks(d, e)
    assert {r.doc_id: r.verdict for r in leaks.leaked(measured).collect()} == {1: "full", 2: "reordered", 3: "part"}
    assert {r.doc_id for r in leaks.leaked(measured, 0.5).collect()} == {1, 2}


def test_tiles_catch_a_reordered_passage():
    rng = random.Random(9)
    a, b = cores.core_text(text(rng, 20)), cores.core_text(text(rng, 20))
    points = cores.code_points
    longest, n, covered, size, in_order = leaks.measure(points(a + b), points("x" * 9 + b + "yyy" + a), 20)
    assert (n, covered, size, in_order) == (2, len(a + b), len(a + b), False)
    assert leaks.measure(points(a), points(a * 2), 20)[1:4] == (1, len(a), len(a))


TOPICS = {"sport": "goal match referee stadium league striker".split(), "law": "court judge verdict appeal statute witness".split(), "software": "compiler parser kernel token module cache".split()}


def topical(rng, topic, n):
    return " ".join(f"The {rng.choice('old new rare plain'.split())} {rng.choice(TOPICS[topic])} was {rng.choice('seen kept sold held'.split())} by {rng.choice(WORDS)} in {rng.randint(1800, 2020)}." for _ in range(n))


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(4)
    names = sorted(TOPICS)
    docs = []
    for i in range(400):
        chosen = rng.sample(names, rng.choice((1, 1, 2)))
        docs.append((i, "\n\n".join(topical(rng, c, 4) for c in chosen), chosen))
    labels = [(i, c if rng.random() > 0.05 else rng.choice(names), "ann") for i, _, cs in docs[:300] for c in cs]
    extra = [(1000, None), (1001, " "), (1002, "Back to top. Menu."), (1003, topical(rng, "law", 4) + " " + topical(rng, "sport", 1)), (1004, "def run(x):\n    return x\n"), (1000, None)]
    d = spark.createDataFrame([(i, t, "x") for i, t, _ in docs] + [(i, t, "x") for i, t in extra], "doc_id long, text string, subject string")
    code = [(2000 + i, f"def {rng.choice(TOPICS['software'])}_{i}(x):\n    # The {rng.choice(TOPICS['software'])} was kept.\n    return x + {i}\n", "x") for i in range(40)]
    d = d.unionByName(spark.createDataFrame(code, "doc_id long, text string, subject string"))
    labels += [(i, "software", "ann") for i, _, _ in code]
    told = spark.createDataFrame(labels + labels[:9] + [(None, "law", "a"), (5, None, "a"), (6, "other", "a")], "doc_id long, subject string, annotator string")
    sample = subjects.labelled_sample(d, told, names)
    assert len(sample[1]) == 340
    model = subjects.train(*sample, names)
    spread = subjects.train(*sample, names, spread=subjects.spread_over(spark))
    assert np.array_equal(model.weights, spread.weights) and np.array_equal(model.thresholds, spread.thresholds)
    found = {}
    for r in subjects.assign(d, model).collect():
        found.setdefault(r.doc_id, set()).add(r.subject)
    right = sum(found.get(i, set()) == set(cs) for i, _, cs in docs[300:])
    assert right >= 95
    assert not {1000, 1001, 1002} & set(found) and found[1003] == {"law"} and found[1004] == {"software"}
    untrained = subjects.train(*subjects.labelled_sample(d, told.limit(0), names), names)
    assert subjects.assign(d, untrained).count() == 0
    assert len(subjects.labelled_sample(d, told, names, most=7)[1]) == 7
    few = subjects.labelled_sample(d, told, names, features=500)
    assert 1 <= len(few[1]) < 10 and len(few[0].ids) <= 500


def test_a_source_of_one_subject_labels_its_other_documents(spark):
    rows = [(i, "Code_A " if i % 2 else "code_a", "x") for i in range(30)] + [(100 + i, "mixed", "x") for i in range(30)] + [(200, None, "x"), (None, "code_a", "x")]
    d = spark.createDataFrame(rows, "doc_id long, source string, text string")
    labels = spark.createDataFrame([(i, "software") for i in range(24)] + [(100 + i, "law" if i % 2 else "sport") for i in range(25)], "doc_id long, subject string")
    named = labels.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    assert sorted(tuple(r) for r in subjects.source_labels(d, named).collect()) == [(i, ["software"]) for i in range(24, 30)]
    assert [w for _, w in sorted(zip(*subjects.labelled_sample(d, labels, ["law", "software", "sport"])[1:], strict=True), key=lambda x: x[1])].count(True) == 6


GO = "func Sum(a []string) (int, error) {\n\treturn 0, nil\n}\n"


@pytest.mark.parametrize("code", [GO.upper(), f"<p>{GO}</p>", f'<div class="x"> <pre>{GO}', "IMPORT OS.PATH\n", "CLASS PARSER:\n    PASS", "a\rdef run(x):\r    return x", "fu\u200bnc Sum(a int) {", "Back to top  public static int sum(int[] a) {\n  // Adds all of them up.\n  int total = 7;", "# Adds all of them.\ntotal = add(a, b)", "if a == 4 {\n\t// Fails early.\n\treturn 0, bad\n}", "/* Frees it. */\n}"])
def test_code_in_any_case_behind_markup_and_by_its_comments(code):
    assert any(u.alone and u.shapes for p in subjects.passages(code) for u in p)


@pytest.mark.parametrize("prose", [None, "", "# Trees\nFor example:\nOaks.", "The court sat;\n# the judge, who was late,\n# left.", "From London import taxes fell.", "Function f(x) rises.", "# Menu\nReturn to top", "Class action:\n", "Public law(s) apply.", "see http://a.b/c\n// \nand so on", "# A\nWith thanks to:"])
def test_prose_is_no_code(prose):
    assert not any(u.alone for p in subjects.passages(prose) for u in p)


def test_two_sentences_count_up_to_reach_apart():
    for apart in range(1, subjects.REACH + 3):
        own = np.full((apart + 1, 2), -np.inf)
        own[0, 0], own[apart, 0] = 2.0, 1.0
        assert subjects._second(own).tolist() == [1.0 if apart <= subjects.REACH else -np.inf, -np.inf]
    assert subjects._second(np.full((0, 2), 1.0)).tolist() == subjects._second(np.full((1, 2), 1.0)).tolist() == [-np.inf, -np.inf]
