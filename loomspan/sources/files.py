"""Readers and writers of lines, tables, archives and shards, and a paged source."""

from __future__ import annotations

import json
import os
import shutil
import urllib.request
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators import schema

#: The sample schema.
SAMPLE = "id string, task string, question string, documents array<struct<doc_id:string,text:string>>, answer string, meta map<string,string>"


def read_lines(spark: SparkSession, path: str | list[str], schema: str = SAMPLE, most: int = 0) -> DataFrame:
    """JSON lines of a known schema, at most ``most`` if it is positive; blank lines are skipped, a malformed one fails the job."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return df.limit(most) if most > 0 else df


def read_document(path: str):
    """One JSON document, such as a description or a registry."""
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def write_document(path: str, value) -> None:
    """One JSON document, with the folders it needs; a reader never sees half of it."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(f"{path}.part", "w", encoding="utf-8") as file:
        json.dump(value, file, ensure_ascii=False, indent=2)
    os.replace(f"{path}.part", path)


def read_config(path: str) -> dict:
    """A YAML configuration as nested values; an empty file is an empty one."""
    try:
        import yaml
    except ImportError as error:
        raise RuntimeError("reading YAML needs the yaml module") from error
    with open(path, encoding="utf-8") as file:
        return yaml.safe_load(file) or {}


def write_config(path: str, config: dict) -> None:
    """A configuration as YAML, keys in their order."""
    import yaml

    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8") as file:
        yaml.safe_dump(config, file, sort_keys=False, allow_unicode=True)


def write_lines(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns strings; no rows and no columns if it is missing."""
    if "://" not in path and not os.path.exists(path):
        return spark.createDataFrame([], "")
    return spark.read.option("header", "true").csv(path)


def number(c: Column) -> Column:
    """A string as a number, 0 where it is none."""
    return F.coalesce(F.try_cast(c, "double") if hasattr(F, "try_cast") else c.try_cast("double"), F.lit(0.0))


def write_table(df: DataFrame, path: str, columns: list[str]) -> None:
    """A CSV in the given column order; absent columns are 0. Reports are small: one file."""
    have = set(df.columns)
    df.select(*(F.col(c) if c in have else F.lit(0).alias(c) for c in columns)).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_parquet(spark: SparkSession, paths: list[str], most: int = 0) -> DataFrame:
    """Parquet files together, at most ``most`` rows over all of them if it is positive."""
    df = spark.read.parquet(*paths)
    return df.limit(most) if most > 0 else df


def matching_files(names: Iterable[str], prefixes: list[str], suffix: str = ".parquet") -> list[str]:
    return sorted(n for n in names if n.endswith(suffix) and any(n.startswith(p) for p in prefixes))


def zip_members(spark: SparkSession, path: str, wanted: DataFrame, suffix: str = ".content") -> DataFrame:
    """``id, text`` of the members of archives, on storage that every worker mounts, whose stem is a wanted id.

    Names are read from the archives' directories and joined with the wanted ids first;
    only members that are left are unpacked, each a row of its own.
    """
    archives = [path] if os.path.isfile(path) else sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".zip"))

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with zipfile.ZipFile(file) as archive:
                    names = [n for n in archive.namelist() if n.endswith(suffix)]
                stems = [os.path.splitext(os.path.basename(n))[0] for n in names]
                yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array([file] * len(names), pa.string()), pa.array(names, pa.string())], names=["id", "file", "member"])

    def unpacked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, files, members = (c.to_pylist() for c in batch.columns)
            for file in dict.fromkeys(files):
                with zipfile.ZipFile(file) as archive:
                    for i, name in ((i, m) for i, f, m in zip(ids, files, members) if f == file):
                        yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([archive.read(name).decode("utf-8", "ignore")])], names=["id", "text"])

    names = spark.createDataFrame([(a,) for a in archives], "file string").repartition(max(1, len(archives))).mapInArrow(listed, "id string, file string, member string")
    kept = names.join(wanted.select("id").distinct(), "id", "left_semi")
    return kept.mapInArrow(unpacked, "id string, text string")


def concatenated(spark: SparkSession, paths: list[str], schema: str = SAMPLE) -> DataFrame:
    """Shards as one table with their place in the argument order."""
    parts = [read_lines(spark, p, schema).withColumn("shard", F.lit(i)) for i, p in enumerate(paths)]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def shard_files(spark: SparkSession, folder: str, pattern: str = r"_(\d{4})_(\d{4})\.jsonl$") -> DataFrame:
    """``file, start, end, lines`` of a folder's shard files, whose ranges are in their names."""
    lines = spark.read.text(folder, pathGlobFilter="*.jsonl").select(F.col("_metadata.file_name").alias("file"), "value").where(F.trim("value") != "")
    counted = lines.groupBy("file").agg(F.count("*").alias("lines"))
    return counted.select("file", F.regexp_extract("file", pattern, 1).try_cast("int").alias("start"), F.regexp_extract("file", pattern, 2).try_cast("int").alias("end"), "lines").where(F.col("start").isNotNull())


def tail(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The last n rows in the given order."""
    return df.orderBy(*[c.desc() for c in order]).limit(n)


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``file, size, sha256`` of each file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"))


def save_index(chunks: DataFrame, vectors: DataFrame, meta: dict, path: str) -> None:
    """Chunks, vectors and a small description side by side."""
    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    vectors.write.mode("overwrite").parquet(f"{path}/vectors")
    chunks.sparkSession.createDataFrame([(json.dumps(meta, sort_keys=True),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def load_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict]:
    return spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/vectors"), json.loads(spark.read.text(f"{path}/meta").first()[0])


def write_traces(df: DataFrame, path: str, key: str = "id") -> None:
    """One JSON file or more per sample, below a folder of its name."""
    df.write.mode("overwrite").partitionBy(key).json(path)


def run_metadata(run_id: str, at: str, configs: list[str], **parts) -> dict:
    """A run's description; fails on an empty run id or time."""
    if not run_id or not at:
        raise ValueError("a run needs an id and a time")
    return {"run_id": run_id, "timestamp_utc": at, "config_paths": configs, **parts}


def snapshot_run(folder: str, described: dict) -> dict:
    """Writes a run's description, which must fit its schema, with copies of its configurations beside it."""
    schema.require(described, "run_metadata")
    write_document(os.path.join(folder, "run_metadata.json"), described)
    for path in described["config_paths"]:
        shutil.copyfile(path, os.path.join(folder, os.path.basename(path)))
    return described


def upsert(registry_path: str, key: str, entry: dict) -> dict:
    """Sets a dotted key of a JSON registry; a missing or unreadable file counts as empty."""
    try:
        with open(registry_path, encoding="utf-8") as file:
            registry = json.load(file)
    except (OSError, ValueError):
        registry = {}
    at = registry
    *above, last = key.split(".")
    for name in above:
        at = at.setdefault(name, {})
    at[last] = entry
    with open(registry_path, "w", encoding="utf-8") as file:
        json.dump(registry, file, ensure_ascii=False, indent=2, sort_keys=True)
    return registry


def fetched(get: Callable[[int, int], list], offset: int, length: int, tries: int = 3) -> list:
    """A page, tried again after failures; the last failure is raised. Certificates are always verified."""
    import time

    for i in range(tries):
        try:
            return get(offset, length)
        except OSError:
            if i == tries - 1:
                raise
            time.sleep(0.2 * (i + 1))
    return []


class Page(InputPartition):
    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class PagedReader(DataSourceReader):
    """Pages of ``path``, a JSON array in a file, or of ``url``, a service that takes offset and length and answers {"rows": [{"row": ...}]}."""

    def __init__(self, options: dict):
        self.path, self.url = options.get("path", ""), options.get("url", "")
        self.size, self.most, self.total = int(options.get("page", 100)), int(options.get("most", 0)), int(options.get("total", -1))

    def partitions(self) -> list[Page]:
        """One per page if the total is known; else one that reads on until a page is short."""
        if self.total < 0:
            return [Page(0, -1)]
        end = min(self.total, self.most) if self.most > 0 else self.total
        return [Page(o, min(self.size, end - o)) for o in range(0, end, self.size)]

    def get(self, offset: int, length: int) -> list:
        if not self.url:
            return read_document(self.path)[offset : offset + length]
        with urllib.request.urlopen(f"{self.url}{'&' if '?' in self.url else '?'}offset={offset}&length={length}", timeout=120) as answer:
            return [r.get("row", {}) for r in json.load(answer).get("rows", [])]

    def read(self, page: Page | None) -> Iterator[tuple]:
        if page is None:  # no pages at all
            return
        at = page.offset
        while True:
            left = page.length if page.length >= 0 else min(self.size, self.most - at) if self.most > 0 else self.size
            rows = fetched(self.get, at, left) if left > 0 else []
            for i, row in enumerate(rows):
                yield at + i, json.dumps(row, ensure_ascii=False, sort_keys=True)
            at += len(rows)
            if page.length >= 0 or len(rows) < left or not rows:
                return


class PagedSource(DataSource):
    """Format 'paged': rows by offset and length. Options path or url, total, page, most."""

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:  # named by the interface
        return "position long, row string"

    def reader(self, schema) -> PagedReader:
        return PagedReader(self.options)


def paged(spark: SparkSession, **options) -> DataFrame:
    spark.dataSource.register(PagedSource)
    return spark.read.format("paged").options(**options).load()


def numbered_lines(df: DataFrame, *order: Column) -> DataFrame:
    return df.withColumn("line", F.row_number().over(Window.orderBy(*order)))
