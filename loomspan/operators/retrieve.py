"""Lexical, dense and hybrid top-k retrieval.

Within a scope a query meets its scope's chunks once, with token counts and vectors as
arrays, and both scores are computed in the row. Without one, a block of queries goes to
every worker, which keeps k chunks of each. Rank is by rounded score, then by a unique
key, so ties have one order everywhere.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import ship_package
from .skew import hot_values, spread_join

#: Queries of up to this many go to every worker at once; more are searched in blocks.
QUERY_BLOCK = 4096
#: Dimensions of hashed vectors.
WIDTH = 64


def bagged(rows: DataFrame, keys: list[str], text: str, width: int = 0) -> DataFrame:
    """``keys, bag, sq``: each row's tokens with their counts, in order, and the sum of squared counts.

    With a ``width`` also vec: a deterministic stand-in for an encoder, a unit vector of
    hashed token counts; a text without tokens has zeros. Counting is one pass over Arrow
    batches, with no shuffle; as an expression it would be evaluated anew by every step
    that reads it.
    """
    ship_package(rows.sparkSession)
    n = len(keys)
    kinds = dict(rows.dtypes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [Counter(t) for t in batch.column(n).to_pylist()]
            offsets = np.zeros(len(bags) + 1, np.int32)
            np.cumsum([len(b) for b in bags], out=offsets[1:])
            tokens, counts = [t for b in bags for t in sorted(b)], [b[t] for b in bags for t in sorted(b)]
            items = pa.StructArray.from_arrays([pa.array(tokens, pa.string()), pa.array(counts, pa.int64())], names=["token", "n"])
            columns = [*batch.columns[:n], pa.ListArray.from_arrays(pa.array(offsets), items), pa.array([sum(v * v for v in b.values()) for b in bags], pa.int64())]
            if width:
                sums = np.zeros((len(bags), width))
                row = np.repeat(np.arange(len(bags)), np.diff(offsets))
                np.add.at(sums, (row, np.fromiter((_slot(t) % width for t in tokens), np.int64, len(tokens))), counts)
                norm = np.sqrt((sums * sums).sum(1, keepdims=True))
                flat = np.divide(sums, norm, out=np.zeros_like(sums), where=norm > 0).ravel()
                columns.append(pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, width, dtype=np.int32)), pa.array(flat)))
            yield pa.RecordBatch.from_arrays(columns, names=[*keys, "bag", "sq", *(["vec"] if width else [])])

    fields = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", bag array<struct<token:string,n:long>>, sq long" + (", vec array<double>" if width else "")
    return rows.select(*keys, T.bag_tokens(F.col(text)).alias("_t")).mapInArrow(run, fields)


@lru_cache(maxsize=1 << 16)
def _slot(token: str) -> int:
    return int(hashlib.md5(token.encode()).hexdigest()[:8], 16)


def _common(asked: Column, held: Column) -> Column:
    """How many tokens two bags share; ``asked``, the shorter, is a map."""
    return F.aggregate(held, F.lit(0).cast("long"), lambda a, e: a + F.least(e["n"], F.coalesce(asked[e["token"]], F.lit(0).cast("long"))))


def scoped_scores(queries: DataFrame, chunks: DataFrame, scope: str = "sample_id", dense: bool = False) -> DataFrame:
    """``qid, chunk_id, lexical``, and ``dense`` if asked for: every chunk of a query's scope with its scores, 6 decimals.

    The lexical score is the common count over the root of the product of squared counts;
    the dense one is the inner product of hashed vectors. A scope with very many chunks is
    split over tasks; chunks of no query's scope don't meet any.
    """
    width = WIDTH if dense else 0
    q, c = bagged(queries, ["qid", scope], "question", width).withColumnRenamed("vec", "_qv"), bagged(chunks, ["chunk_id", scope], "text", width)
    q = q.withColumn("_q", F.map_from_entries("bag")).withColumnRenamed("sq", "_qs").drop("bag")
    both = spread_join(c, q, scope, hot_values(chunks, scope))
    norm = F.sqrt((F.col("sq") * F.col("_qs")).cast("double"))
    lexical = F.when(norm > 0, F.round(_common(F.col("_q"), F.col("bag")) / norm, 6)).otherwise(F.lit(0.0))
    inner = lambda: F.round(F.aggregate(F.zip_with("_qv", "vec", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x), 6)
    return both.select("qid", "chunk_id", lexical.alias("lexical"), *([inner().alias("dense")] if dense else []))


def top_k(scored: DataFrame, k: int, query: str = "qid", key: str = "chunk_id") -> DataFrame:
    """Adds rank, 1 to k, by score and then key."""
    w = Window.partitionBy(query).orderBy(F.col("score").desc(), key)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_top_k(queries: DataFrame, chunks: DataFrame, k: int = 5, scope: str = "sample_id") -> DataFrame:
    """The k best chunks of each query's scope; those without a common token follow with score 0."""
    return top_k(scoped_scores(queries, chunks, scope).withColumnRenamed("lexical", "score"), k)


def fused(dense: DataFrame, lexical: DataFrame, k: int = 5, pool: int = 20, dense_weight: float = 0.65, lexical_weight: float = 0.35) -> DataFrame:
    """Hybrid top k of two scored lists: the best ``max(k, pool)`` of either, joined by chunk.

    A chunk that one list lacks has a raw 0 there. Dense scores move from [-1, 1] to
    [0, 1]; both are cut to it. Weights that add up to 0 or less become the defaults.
    """
    most = max(k, pool)
    a = top_k(dense, most).select("qid", "chunk_id", F.col("score").alias("d"))
    b = top_k(lexical, most).select("qid", "chunk_id", F.col("score").alias("l"))
    return top_k(_weighed(a.join(b, ["qid", "chunk_id"], "full"), dense_weight, lexical_weight), k)


def _weighed(listed: DataFrame, dense_weight: float, lexical_weight: float) -> DataFrame:
    """score_dense, score_lexical and their weighted score of qid, chunk_id, d and l."""
    if dense_weight + lexical_weight <= 0:
        dense_weight, lexical_weight = 0.65, 0.35
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
    d, l = unit((F.coalesce("d", F.lit(0.0)) + 1) / 2), unit(F.coalesce("l", F.lit(0.0)))
    both = listed.select("qid", "chunk_id", d.alias("score_dense"), l.alias("score_lexical"))
    return both.withColumn("score", F.round(F.col("score_dense") * dense_weight + F.col("score_lexical") * lexical_weight, 9))


def hybrid_top_k(scores: DataFrame, k: int = 5, pool: int = 20, dense_weight: float = 0.65, lexical_weight: float = 0.35) -> DataFrame:
    """As `fused`, of scores side by side; a score of 0 is in no list."""
    most, own = max(k, pool), Window.partitionBy("qid")
    place = lambda c: F.when(F.col(c) > 0, F.row_number().over(own.orderBy(F.when(F.col(c) > 0, F.col(c)).desc_nulls_last(), "chunk_id")))
    listed = scores.withColumns({"_d": place("dense"), "_l": place("lexical")}).where((F.col("_d") <= most) | (F.col("_l") <= most))
    d, l = (F.when(F.col(r) <= most, F.col(c)) for r, c in (("_d", "dense"), ("_l", "lexical")))
    return top_k(_weighed(listed.select("qid", "chunk_id", d.alias("d"), l.alias("l")), dense_weight, lexical_weight), k)


def search(mode: str, queries: DataFrame, chunks: DataFrame, k: int = 5, scope: str | None = "sample_id", formal: bool = False, built: tuple[str, ...] = ("lexical", "dense", "hybrid")) -> DataFrame:
    """Dispatch by strategy: 'hybrid', 'dense' or 'lexical'; within a scope, or over all chunks if it is None.

    ``built`` names the indexes there are. A strategy without one falls back to lexical, or
    fails if formal. k is at least 1; where there are fewer chunks, all have a rank. Dense
    and hybrid lists have only chunks with something in common with the query.
    """
    k = max(1, k)
    if mode not in ("lexical", "dense", "hybrid") or mode not in built:
        if formal:
            raise ValueError(f"no index of kind {mode}")
        mode = "lexical"
    if scope is None:
        return global_search(mode, queries, chunks, k)
    if mode == "lexical":
        return lexical_top_k(queries, chunks, k, scope)
    scores = scoped_scores(queries, chunks, scope, True)
    return hybrid_top_k(scores, k) if mode == "hybrid" else top_k(scores.where("dense > 0").select("qid", "chunk_id", F.col("dense").alias("score")), k)


def global_search(mode: str, queries: DataFrame, chunks: DataFrame, k: int = 5, pool: int = 20) -> DataFrame:
    """A stated set of queries (qid, question) over all chunks, in blocks: exact, and only k rows of each query and task move.

    Chunks without anything in common with a query aren't listed.
    """
    q, c = bagged(queries, ["qid"], "question", WIDTH), bagged(chunks, ["chunk_id"], "text", WIDTH)
    lists = {}
    if mode in ("dense", "hybrid"):
        lists["dense"] = dense_top_k(c.select("chunk_id", "vec"), q.select("qid", "vec"), max(k, pool) if mode == "hybrid" else k, "chunk_id", "vec", "qid").where("score > 0")
    if mode in ("lexical", "hybrid"):
        lists["lexical"] = lexical_block_top_k(c.select("chunk_id", "bag", "sq"), q.select("qid", "bag", "sq"), max(k, pool) if mode == "hybrid" else k)
    return fused(lists["dense"], lists["lexical"], k, pool) if mode == "hybrid" else lists[mode]


def _blocks(queries: DataFrame, key: str, columns: list[str]) -> Iterator[list]:
    """The queries in blocks of at most QUERY_BLOCK rows, which the driver holds one at a time."""
    after = None
    while True:
        rest = queries if after is None else queries.where(F.col(key) > F.lit(after))
        rows = rest.where(F.col(key).isNotNull()).select(key, *columns).orderBy(key).limit(QUERY_BLOCK).collect()
        if rows:
            yield rows
            after = rows[-1][0]
        if len(rows) < QUERY_BLOCK:
            return


def _best(rows: DataFrame, key: str, kind: str, ids: list, k: int, score: Callable[[pa.RecordBatch], np.ndarray]) -> DataFrame:
    """``q, key, score``: of each task's rows the k best of every query, by score and then key; ``score`` gives a row per query."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, values = np.zeros((len(ids), 0), object), np.zeros((len(ids), 0))
        for batch in batches:
            found = score(batch)
            own = np.array(batch.column(0).to_pylist(), object)
            # what can't be among the k best by score alone is dropped before keys are compared
            every = np.concatenate([values, found], 1)
            if every.shape[1] > k:
                edge = -np.partition(-every, k - 1, 1)[:, k - 1]
            new_names, new_values = np.full((len(ids), k), None, object), np.full((len(ids), k), -np.inf)
            for j in range(len(ids)):
                seen = every[j]
                at = np.flatnonzero((seen >= edge[j]) & np.isfinite(seen)) if every.shape[1] > k else np.flatnonzero(np.isfinite(seen))
                if not len(at):
                    continue
                near = np.array([names[j, i] if i < names.shape[1] else own[i - names.shape[1]] for i in at], object)
                order = sorted(range(len(at)), key=lambda i: (-seen[at[i]], near[i]))[:k]
                new_names[j, : len(order)], new_values[j, : len(order)] = near[order], seen[at][order]
            names, values = new_names, new_values
        kept = [(j, n, v) for j in range(len(ids)) for n, v in zip(names[j], values[j]) if np.isfinite(v)]
        for lo in range(0, len(kept), 10_000):
            part = kept[lo : lo + 10_000]
            yield pa.RecordBatch.from_pydict({"q": [r[0] for r in part], key: [r[1] for r in part], "score": [r[2] for r in part]})

    return rows.mapInArrow(run, f"q long, `{key}` {kind}, score double")


def _collected(parts: list[tuple[list, DataFrame]], name: str, kind: str, key: str, k: int) -> DataFrame:
    """The best of all tasks, with the queries' own ids again."""
    whole = None
    for ids, found in parts:
        named = found.sparkSession.createDataFrame(list(enumerate(ids)), f"q long, `{name}` {kind}")
        part = found.join(F.broadcast(named), "q").drop("q").select(name, key, "score")
        whole = part if whole is None else whole.unionByName(part)
    return top_k(whole, k, name, key)


def lexical_block_top_k(chunks: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``qid, chunk_id, score, rank`` over all chunks (chunk_id, bag, sq), of queries (qid, bag, sq)."""
    ship_package(chunks.sparkSession)
    kind, own = dict(chunks.dtypes)["chunk_id"], dict(queries.dtypes)["qid"]
    parts = []
    for rows in _blocks(queries, "qid", ["bag", "sq"]):
        holding: dict[str, list[tuple[int, int]]] = {}
        for j, r in enumerate(rows):
            for e in r.bag:
                holding.setdefault(e.token, []).append((j, e.n))
        index = {t: (np.array([x[0] for x in h]), np.array([x[1] for x in h])) for t, h in holding.items()}
        norms = np.array([r.sq for r in rows], float)
        parts.append(([r.qid for r in rows], _best(chunks.select("chunk_id", "bag", "sq"), "chunk_id", kind, list(rows), k, _shared(index, norms))))
    empty = chunks.sparkSession.createDataFrame([], f"q long, chunk_id {kind}, score double")
    return _collected(parts or [([], empty)], "qid", own, "chunk_id", k)


def _shared(index: dict, norms: np.ndarray) -> Callable[[pa.RecordBatch], np.ndarray]:
    def score(batch: pa.RecordBatch) -> np.ndarray:
        out = np.zeros((len(norms), batch.num_rows))
        for i, bag in enumerate(batch.column(1).to_pylist()):
            for e in bag:
                if (held := index.get(e["token"])) is not None:
                    out[held[0], i] += np.minimum(held[1], e["n"])
        root = np.sqrt(norms[:, None] * np.array(batch.column(2).to_pylist(), float)[None, :])
        return np.where(out > 0, np.round(out / np.where(root > 0, root, 1), 6), -np.inf)

    return score


def best_per_key(scored: DataFrame, query: str = "qid", key: str = "chunk_id") -> DataFrame:
    """The best scored row of each key within its query; rows with a blank key all stay."""
    w = Window.partitionBy(query, key).orderBy(F.col("score").desc())
    blank = F.coalesce(key, F.lit("")) == ""
    return scored.withColumn("_rn", F.row_number().over(w)).where(blank | (F.col("_rn") == 1)).drop("_rn")


def fallback_rank(queries: DataFrame, chunks: DataFrame, k: int = 3, scope: str = "sample_id") -> DataFrame:
    """Chunks of a query's scope by how many distinct question tokens they contain, then by length."""
    tokens = queries.select("qid", scope, F.array_distinct(T.query_tokens(F.col("question"))).alias("q"))
    low = F.lower(F.coalesce("text", F.lit("")))
    both = spread_join(chunks.select(scope, "chunk_id", "text"), tokens, scope, hot_values(chunks, scope))
    hits = both.select("qid", "chunk_id", F.size(F.filter("q", lambda t: F.contains(low, t))).cast("long").alias("hits"), F.length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    w = Window.partitionBy("qid").orderBy(F.col("hits").desc(), F.col("size").desc(), "chunk_id")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dense_top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", value: str = "embedding", name: str | None = None) -> DataFrame:
    """``qid, key, score, rank``: exact inner products of every query with every vector.

    Each task multiplies its vectors with a block of the queries and keeps k of each, so
    k rows per query and task move, however many vectors there are. Null vectors and
    those of another length have no row. A query by ``key`` doesn't find itself; one by
    another ``name`` is of other things.
    """
    ship_package(vectors.sparkSession)
    other, own = name is not None, name or key
    kind, asked = dict(vectors.dtypes)[key], dict(queries.dtypes)[own]
    parts = []
    for rows in _blocks(queries.where(F.col(value).isNotNull()), own, [value]):
        ids = [r[0] for r in rows]
        parts.append((ids, _best(vectors.where(F.col(value).isNotNull() & (F.size(value) == len(rows[0][1]))).select(key, value), key, kind, ids, k, _products(np.array([r[1] for r in rows], np.float64), None if other else np.array(ids, object)))))
    empty = vectors.sparkSession.createDataFrame([], f"q long, `{key}` {kind}, score double")
    return _collected(parts or [([], empty)], "qid", asked, key, k)


def _products(matrix: np.ndarray, same: np.ndarray | None) -> Callable[[pa.RecordBatch], np.ndarray]:
    def score(batch: pa.RecordBatch) -> np.ndarray:
        flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        out = np.round(matrix @ flat.reshape(batch.num_rows, matrix.shape[1]).T, 6)
        if same is not None:
            out[same[:, None] == np.array(batch.column(0).to_pylist(), object)[None, :]] = -np.inf
        return out

    return score
