"""Runs a query on Spark and its SQL on DuckDB and compares the rows, columns by name."""

import math

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings doc_labels subjects eval_items minilongbench_tiny corpus_chunks student_train baseline_rag".split()


def connect(d):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    return c


def plain(x):
    if x is None or x is pd.NaT:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9)
    if hasattr(x, "tolist") and not isinstance(x, (str, bytes)):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, bool):
        return x
    return x


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted((tuple(plain(x) for x in r) for r in frame.astype(object).itertuples(index=False)), key=repr)


def differences(spark, connection, query, d):
    mine = query.build(spark, d).toPandas()
    theirs = connection.execute(query.sql).df()
    if sorted(mine.columns) != sorted(theirs.columns):
        return f"columns {sorted(mine.columns)} and {sorted(theirs.columns)}"
    a, b = rows(mine), rows(theirs)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows; only here: {[x for x in a if x not in set(b)][:2]}, only there: {[x for x in b if x not in set(a)][:2]}"
    wrong = [(x, y) for x, y in zip(a, b) if repr(x) != repr(y)]
    return f"{len(wrong)} of {len(a)} rows, first {wrong[0]}" if wrong else ""
