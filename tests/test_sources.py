import json
import zipfile

import pytest

from loomspan.plans import runs
from loomspan.sources import adapters, files
from loomspan.streaming import progress
from pyspark.sql import functions as F

DOC = "array<struct<doc_id:string,text:string>>"


def test_lines_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", None, "q", [("d", "世🙂")], "x", {"k": "v"})], files.SAMPLE)
    path = str(tmp_path / "lines")
    files.write_lines(df, path)
    files.write_lines(df, path, append=True)
    assert [r.asDict(True) for r in files.read_lines(spark, path).collect()] == [r.asDict(True) for r in df.collect()] * 2
    (tmp_path / "bad.jsonl").write_text('{"id": "a"}\n\nnot json\n')
    with pytest.raises(Exception):
        files.read_lines(spark, str(tmp_path / "bad.jsonl")).collect()


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([("m", "1.5"), ("n", "x")], "method string, em string")
    files.write_table(df.withColumn("em", files.number(F.col("em"))), str(tmp_path / "t"), ["method", "em", "f1"])
    back = files.read_table(spark, str(tmp_path / "t"))
    assert [tuple(r) for r in back.orderBy("method").collect()] == [("m", "1.5", "0"), ("n", "0.0", "0")]
    assert files.read_table(spark, str(tmp_path / "none")).count() == 0


def test_archives_shards_digests_and_pages(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("x/one.content", "first")
        archive.writestr("x/two.content", "second")
    wanted = spark.createDataFrame([("two",)], "id string")
    assert [tuple(r) for r in files.zip_members(spark, str(tmp_path / "a.zip"), wanted).collect()] == [("two", "second")]
    shards = tmp_path / "shards"
    shards.mkdir()
    (shards / "run_0000_0002.jsonl").write_text('{"id":"a"}\n{"id":"b"}\n\n')
    (shards / "other.jsonl").write_text('{"id":"c"}\n')
    assert [(r.start, r.end, r.lines) for r in files.shard_files(spark, str(shards)).collect()] == [(0, 2, 2)]
    assert {r.file for r in files.digests(spark, str(shards)).collect()} == {"run_0000_0002.jsonl", "other.jsonl"}
    both = files.concatenated(spark, [str(shards / "other.jsonl"), str(shards / "run_0000_0002.jsonl")])
    assert [r.id for r in both.orderBy("shard", "id").collect()] == ["c", "a", "b"]
    (tmp_path / "rows.json").write_text(json.dumps([{"n": i} for i in range(25)]))
    paged = files.paged(spark, path=str(tmp_path / "rows.json"), total=25, page=10, most=23)
    assert paged.count() == 23 and paged.rdd.getNumPartitions() == 3
    assert files.matching_files(["b/x.parquet", "a/x.parquet", "a/y.txt"], ["a/"]) == ["a/x.parquet"]


def test_index_registry_and_metadata(spark, tmp_path):
    chunks = spark.createDataFrame([("c", "t")], "chunk_id string, text string")
    files.save_index(chunks, chunks.withColumn("v", F.array(F.lit(1.0))), {"dim": 1}, str(tmp_path / "i"))
    assert files.load_index(spark, str(tmp_path / "i"))[2] == {"dim": 1}
    path = str(tmp_path / "r.json")
    files.upsert(path, "a.b", {"n": 1})
    assert files.upsert(path, "a.c", {"n": 2}) == {"a": {"b": {"n": 1}, "c": {"n": 2}}}
    with pytest.raises(ValueError):
        files.run_metadata("", "now", [])


def rows(df):
    return {r.id: (r.question, [(e.doc_id, e.text) for e in r.documents], r.answer) for r in df.collect()}


def test_adapters(spark):
    hot = spark.createDataFrame([("h", "q", "a", "bridge", "easy", (["T", None], [["s1", " ", "s2"], []]))], "id string, question string, answer string, type string, level string, context struct<title:array<string>,sentences:array<array<string>>>")
    assert rows(adapters.titled_sentences(hot, "train")) == {"hpqa_train_h": ("q", [("T", "s1\ns2")], "a")}
    mus = spark.createDataFrame([("m", None, "", [(None, "body"), ("x", " ")])], "id string, question string, answer string, paragraphs array<struct<title:string,paragraph_text:string>>")
    assert rows(adapters.paragraphs(mus, "valid")) == {"musique_valid_m": (adapters.NO_QUESTION, [("para1", "body")], adapters.NO_ANSWER)}
    answers = [[{"unanswerable": True, "free_form_answer": "no", "extractive_spans": [], "yes_no": None}, {"unanswerable": False, "free_form_answer": "", "extractive_spans": [" ", "span"], "yes_no": True}], [{"unanswerable": True, "free_form_answer": "", "extractive_spans": [], "yes_no": None}]]
    paper = spark.createDataFrame(
        [("p", "T", "abs", (["S1", "S2"], [["a", "b"], []]), (["q1", "q2"], ["i1", "i2"], answers))],
        "id string, title string, abstract string, full_text struct<section_name:array<string>,paragraphs:array<array<string>>>, qas struct<question:array<string>,question_id:array<string>,answers:array<array<struct<unanswerable:boolean,free_form_answer:string,extractive_spans:array<string>,yes_no:boolean>>>>",
    )
    assert rows(adapters.papers(paper, "train")) == {"qasper_train_p_i1": ("q1", [("abstract", "abs"), ("sec_01", "S1\na\nb")], "span")}
    nar = spark.createDataFrame([(("d9", "book", "u", ("sum",)), ("why?",), [("",), ("ok",)])], "document struct<id:string,kind:string,url:string,summary:struct<text:string>>, question struct<text:string>, answers array<struct<text:string>>")
    assert [v[1:] for v in rows(adapters.narrative(nar, "train")).values()] == [([("d9", "sum")], "ok")]
    full = spark.createDataFrame([("d9", "whole")], "id string, text string")
    assert [v[1] for v in rows(adapters.narrative(nar, "train", full)).values()] == [[("d9", "whole")]]
    repo = spark.createDataFrame([("o/r", "f.py", "import x", "a = 1", "b = 2", "2k", [("p", "i", "s")])], "repo_name string, file_path string, import_statement string, cropped_code string, next_line string, level string, context array<struct<path:string,identifier:string,snippet:string>>")
    made = list(rows(adapters.repositories(repo, "python")).values())[0]
    assert [e[0] for e in made[1]] == ["target_prefix", "ctx_01"] and made[2] == "b = 2"
    long = spark.createDataFrame([("x1", "q", "head Passage 1: no\nPassage 1:\none\nPassage 2:\n\nPassage 3: three", [" ", "b"], "en", 5)], "_id string, input string, context string, answers array<string>, language string, length int")
    assert rows(adapters.long_context(long, "musique")) == {"mlb_musique_x1": ("q", [("passage_1", "one"), ("passage_3", "three")], "unknown")}


def test_report_and_resumed_run(spark, data_dir):
    from loomspan.queries import base

    own, found = base.samples(spark, data_dir), base.preds(spark, data_dir)
    tables = runs.report(found, own, ["multi_doc_qa", "code_qa"])
    assert tables["overall"].first().n_samples == found.count()
    assert tables["key_macro"].first().n_tasks == 2
    rest = runs.agent_run(own.limit(5), base.chunks(spark, data_dir), own.limit(2))
    assert rest.count() <= 5


def test_streams(spark, tmp_path, data_dir):
    events = spark.read.parquet(f"{data_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    folder = str(tmp_path / "in")
    events.select(*[c.split(" ")[0] for c in progress.EVENTS.split(", ")]).repartition(2).write.parquet(folder)
    end = events.agg(F.max("ts")).first()[0]
    late = spark.createDataFrame([(10**9, end, 10**6, "click", 1.0, "{}")], progress.EVENTS).withColumn("ts", F.col("ts") + F.expr("INTERVAL 2 DAYS"))
    stream = progress.read_appended(spark, folder)

    def run(df, name, mode="append"):
        query = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
        query.processAllAvailable()
        late.write.mode("append").parquet(folder)
        query.processAllAvailable()
        query.stop()
        return spark.table(name)

    counts = run(progress.throughput(stream), "counts", "complete")
    assert counts.agg(F.sum("n")).first()[0] == events.count() + 1
    stalled = run(progress.stalls(progress.read_appended(spark, folder)), "stalled")
    assert stalled.count() >= events.select("user_id").distinct().count() * 0.9
    seen = []
    watcher = progress.watch(progress.read_appended(spark, folder), lambda df, i: seen.append(df.count()), str(tmp_path / "cp"))
    watcher.awaitTermination(60)
    assert sum(seen) == events.count() + 2
