"""Column functions against plain Python, on text of all kinds."""

import math
import re
from collections import Counter

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomspan.functions import text as T
from loomspan.functions import answers
from loomspan.operators import chunks, memory, metrics
from pyspark.sql import functions as F

TEXT = st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB c1_,.。！？ 世界é　 \n\t🙂<>/final"), max_size=30)), min_size=1, max_size=25)
FEW = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, t {kind}")


def collected(df, c):
    return [r[0] for r in df.select("i", c.alias("c")).orderBy("i").select("c").collect()]


def scored(t):
    return re.sub(r"[，。！？、,.!?;:\"'`（）()\[\]{}<>《》]", "", re.sub(r"\s+", "", (t or "").lower()))


def f1(p, g):
    p, g = scored(p), scored(g)
    if not p or not g:
        return float(not p and not g)
    same = sum((Counter(p) & Counter(g)).values())
    return 2 * (same / len(p)) * (same / len(g)) / (same / len(p) + same / len(g)) if same else 0.0


@FEW
@given(TEXT)
def test_scored_tokens_and_numbers(spark, values):
    df = column(spark, values)
    assert collected(df, T.scored(F.col("t"))) == [scored(v) for v in values]
    assert collected(df, T.query_tokens(F.col("t"))) == [re.findall(r"[a-z0-9_]+|[一-鿿]", (v or "").lower()) for v in values]
    number = [(re.search(r"(?<![a-zA-Z0-9_])(-?\d+(?:[.,]\d+)?)", v or "") or [""])[0].replace(",", "") for v in values]
    assert collected(df, T.first_number(F.col("t"))) == [n[:-2] if n.endswith(".0") else n for n in number]


@FEW
@given(TEXT)
def test_char_f1(spark, values):
    pairs = list(zip(values, reversed(values)))
    df = spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(pairs)], "i int, p string, g string")
    got = [r.f1 for r in metrics.char_f1(df, "i", "p", "g").orderBy("i").collect()]
    assert all(math.isclose(a, f1(p, g), abs_tol=1e-12) for a, (p, g) in zip(got, pairs))


def windows(text, size, overlap):
    size = size if size > 0 else 512
    overlap = max(0, overlap)
    overlap = overlap if overlap < size else max(0, size // 4)
    out, start = [], 0
    while start < len(text or ""):
        end = min(len(text), start + size)
        if text[start:end].strip():
            out.append((start, end, text[start:end]))
        if end == len(text):
            break
        start = end - overlap
    return out


def test_windows(spark):
    texts = [None, "", "   ", "abc", "x" * 8, "x" * 9, "🙂世" * 20, "ab" + " " * 30 + "cd"]
    df = spark.createDataFrame([("s", i, f"d{i}", t) for i, t in enumerate(texts)], "id string, pos int, doc_id string, text string")
    for size, overlap in ((8, 3), (8, 8), (8, 0), (1, 0), (0, -1)):
        rows = chunks.windows(df, size, overlap).orderBy("doc_id", "offset_start").collect()
        for i, t in enumerate(texts):
            own = [r for r in rows if r.doc_id == f"d{i}"]
            assert [(r.offset_start, r.offset_end, r.text) for r in own] == windows(t, size, overlap)
            assert [r.chunk_id for r in own] == [f"s_d{i}_{j}" for j in range(len(own))]


def test_protocol(spark):
    cases = {"<final>a</final>": ("final", "a"), " <SEARCH> k\nw </search> ": ("search", "k\nw"), "x <final>a</final> y": (None, None), "<final>a</final><search>b</search>": (None, None), "": (None, None)}
    relaxed = {"x <final>a</final> y": ("final", "a"), "<search>key": ("search", "key"), "final>a</final>": ("final", "a"), "none": (None, None), None: (None, None)}
    for expected, parse in ((cases, T.strict_tag), (relaxed, T.relaxed_tag)):
        df = column(spark, list(expected))
        tag, content = parse(F.col("t"))
        assert list(zip(collected(df, tag), collected(df, content))) == list(expected.values())


def test_best_sentence_of_all_documents(spark):
    cases = [["Nothing here.", "Old.\nThe red fox sleeps. Then"], [None, " ", "A fox! The red fox"], ["The red fox", "The red fox too"], [], None, ["", None], ["no", "none"]]
    df = spark.createDataFrame([(i, "red fox?", None if c is None else [(t,) for t in c]) for i, c in enumerate(cases)], "i int, q string, t array<struct<text:string>>")
    assert collected(df, T.best_sentence(F.col("q"), T.context(F.col("t")))) == ["The red fox sleeps. Then", "The red fox", "The red fox", "", "", "\n", "no"]


def test_all_chunks_are_evidence(spark):
    rows = [("s", f"c{i}", "d", f" text {i}\n") for i in range(7)] + [("t", "c", None, None)]
    df = spark.createDataFrame(rows, "sample_id string, chunk_id string, doc_id string, text string")
    lines = [f"[d#c{i}] text {i}" for i in range(7)]
    got = lambda *a: {r.sample_id: r.evidence for r in memory.formatted_evidence(*a).collect()}
    assert got(df) == {"s": "\n".join(lines), "t": "[#c] "}
    assert got(df, 4) == {"s": "\n".join(lines[:4]), "t": "[#c] "}
    assert got(df.withColumn("pos", F.lit(0) - F.substring("chunk_id", 2, 1).try_cast("int")))["s"] == "\n".join(lines[::-1])


def test_answers_are_cleaned(spark):
    prose = [("Wait, maybe Answer: Paris and", "Paris"), (None, ""), ("", ""), ("It seems that\u3000the  end , which", "that the end"), ("I think. Well, so.", ". Well, so."), ("wait The first one is it. And more", "The first one is it."), ("x" * 230 + ". End here", "x" * 230 + "."), ("Answer：答案是；", "答案是；"), ("a, or;", "a, or")]
    code = [("The next line of code is: ```python\nfoo = 1\n```", "foo = 1"), ("Use `return x` here", "return x"), (None, ""), ("plain words\r\nfoo(1)\r\nbar", "foo(1)"), ("` ` and `y`", "y"), ("z" * 300, "z" * 160), ("just words", "just words"), ("But path: a/b ,;", "a/b")]
    short = [("He was born in Rome, Italy. Then he left.", "Where was he born?", "Rome, Italy"), (None, None, ""), ("It was **Ada**, they say", "Who was it?", "Ada"), ("One. Two", "x", "One."), ("position of chief clerk; x", "Which position?", "chief clerk"), ("y" * 120, "", "y" * 96)]
    for cases, column in ((prose, answers.prose(F.col("a"))), (code, answers.code(F.col("a")))):
        df = spark.createDataFrame(list(enumerate(cases)), "i int, r struct<a:string,w:string>").select("i", "r.*")
        assert [(r.a, r.got) for r in df.select("i", "a", column.alias("got")).orderBy("i").collect()] == cases
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(short)], "i int, a string, q string, w string")
    assert [r.got for r in df.select("i", answers.compact(F.col("a"), F.col("q")).alias("got")).orderBy("i").collect()] == [c[2] for c in short]
