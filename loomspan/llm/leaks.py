"""Evaluation texts in a training corpus, by greedy string tiling over Karp-Rabin seeds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_values, spread_join
from ..session import checkpointed, ship_package, spread
from . import cores, partials

#: Items of up to this many code points in all go to every worker; more are joined by seed.
MOST_BROADCAST = 8_000_000
#: Shortest tile, and shortest run by which a text holds an item of its language.
TILE, LEAST, LEAST_ZH = 20, 50, 20
#: Places where windows meet that are listed one by one.
MOST_HITS = 100_000
_BITS = 22
_FIELDS = "longest int, tiles int, covered int, size int, in_order boolean, part string, run int"
_PARTS = ("passage", "question")


def tiles(item: np.ndarray, text: np.ndarray, least: int, most: int = MOST_HITS) -> list[tuple[int, int, int]]:
    """Greedy string tiling: ``(item start, text start, length)``, longest first.

    Common runs of at least ``least`` code points are found by the hashes of all windows of
    that length; the longest whose places are all unmarked is marked, what is left of others
    is tried again at its own length, until none is left. Where windows meet more than
    ``most`` times, as in repetitive texts, the runs aren't listed: the longest unmarked
    length is searched for by halving, and all runs of that length are marked in order.
    """
    a, b = cores.window_hashes(item, least), cores.window_hashes(text, least)
    if not len(a) or not len(b):
        return []
    order = np.argsort(a, kind="stable")
    lo, hi = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    count = hi - lo
    total = int(count.sum())
    if not total:
        return []
    if total > most:
        return _by_length(item, text, least)
    t = np.repeat(np.arange(len(b)), count)
    at = order[np.arange(total) - np.repeat(np.cumsum(count) - count - lo, count)]
    return _by_run(item, text, least, at, t)


def _by_run(item: np.ndarray, text: np.ndarray, least: int, at: np.ndarray, t: np.ndarray) -> list[tuple[int, int, int]]:
    """Tiles from all places where windows meet: neighbours on one diagonal are one run."""
    order = np.lexsort((t, t - at))
    at, t = at[order], t[order]
    first = np.concatenate([[True], (np.diff(t - at) != 0) | (np.diff(t) != 1)])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(t))) + least - 1
    found: dict[int, list[tuple[int, int]]] = {}
    for size, x, y in zip(sizes.tolist(), at[starts].tolist(), t[starts].tolist()):
        found.setdefault(size, []).append((x, y))
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out = []
    while found:
        size = max(found)
        for x, y in sorted(found.pop(size)):
            free = ~(in_item[x : x + size] | in_text[y : y + size])
            if free.all():
                in_item[x : x + size] = in_text[y : y + size] = True
                out.append((x, y, size))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[0], free.view(np.int8), [0]])))
            for s, e in zip(edges[::2], edges[1::2]):
                if e - s >= least:
                    found.setdefault(int(e - s), []).append((x + int(s), y + int(s)))
    return out


def _free(marked: np.ndarray, size: int) -> np.ndarray:
    """Where a run of ``size`` unmarked places begins."""
    before = np.concatenate([[0], np.cumsum(marked)])
    return np.flatnonzero(before[size:] == before[:-size])


def _longest(marked: np.ndarray) -> int:
    edges = np.flatnonzero(np.diff(np.concatenate([[1], marked.view(np.int8), [1]])))
    return int(np.diff(edges)[::2].max(initial=0)) if len(edges) else 0


def _by_length(item: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Tiles of repetitive texts, length by length."""
    in_item, in_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out: list[tuple[int, int, int]] = []

    def common(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        x, y = _free(in_item, size), _free(in_text, size)
        a, b = cores.window_hashes(item, size)[x], cores.window_hashes(text, size)[y]
        return x, a, y, b

    high = min(_longest(in_item), _longest(in_text))
    while high >= least:
        low = least - 1  # a common free run of ``low`` exists, or low is too short to count
        while low < high:
            middle = (low + high + 1) // 2
            _, a, _, b = common(middle)
            if np.isin(a, b).any():
                low = middle
            else:
                high = middle - 1
        if low < least:
            return out
        x, a, y, b = common(low)
        shared = np.isin(a, b)
        x, a = x[shared], a[shared]
        order = np.argsort(b, kind="stable")
        b, y = b[order], y[order]
        at, end = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
        tried: dict[int, int] = {}
        i = 0
        while i < len(x):
            p = int(x[i])
            j, stop = tried.get(int(at[i]), int(at[i])), int(end[i])
            while j < stop:
                q = int(y[j])
                busy = np.flatnonzero(in_text[q : q + low])
                if not len(busy):
                    break
                j += max(1, int(np.searchsorted(y[j:stop], q + busy[-1] + 1)))
            tried[int(at[i])] = j
            if j < stop:
                in_item[p : p + low] = in_text[q : q + low] = True
                out.append((p, q, low))
                i = int(np.searchsorted(x, p + low))
            else:
                i += 1
        high = min(low, _longest(in_item), _longest(in_text))
    return out


def measure(item: np.ndarray, text: np.ndarray, least: int) -> tuple[int, int, int, int, bool] | None:
    """Longest tile, number of tiles, code points covered, the item's size, and whether the tiles keep their order."""
    found = tiles(item, text, least)
    if not found:
        return None
    found.sort()
    places = [t for _, t, _ in found]
    return max(f[2] for f in found), len(found), sum(f[2] for f in found), len(item), places == sorted(places)


def _least(lang: str | None) -> int:
    return LEAST_ZH if (lang or "").strip().lower().startswith("zh") else LEAST


class Seeds:
    """All windows of all items' cores, of the length of a run in the item's language, for look-up by hash."""

    def __init__(self, rows: list[tuple[int, str | None, str | None, str | None]]):
        self.cores, self.owner = [], []  # by text number
        per: dict[int, list[tuple[np.ndarray, int]]] = {}
        for item_id, lang, *texts in rows:
            for part, text in zip(_PARTS, texts):
                points, _ = cores.cores([text])
                h = cores.window_hashes(points, _least(lang))
                if len(h):
                    per.setdefault(_least(lang), []).append((h, len(self.cores)))
                    self.cores.append(points)
                    self.owner.append((item_id, part, _least(lang)))
        self.by_length = {}
        for k, parts in per.items():
            h = np.concatenate([p[0] for p in parts])
            n = np.repeat([p[1] for p in parts], [len(p[0]) for p in parts])
            order = np.argsort(h, kind="stable")
            bits = np.zeros((1 << _BITS) // 8, np.uint8)
            partials.set_bits(bits, h, _BITS)
            self.by_length[k] = (h[order], n[order], bits)

    def hits(self, points: np.ndarray, offsets: np.ndarray) -> set[tuple[int, int]]:
        """``(core number, text number)`` of all cores that share a window with an item's text."""
        out: set[tuple[int, int]] = set()
        for k, (h, n, bits) in self.by_length.items():
            seen, owner = cores.block_windows(points, offsets, k)
            maybe = np.flatnonzero(partials.has_bits(bits, seen))
            seen, owner = seen[maybe], owner[maybe]
            lo, hi = np.searchsorted(h, seen, "left"), np.searchsorted(h, seen, "right")
            counts = hi - lo
            if counts.any():
                first = np.cumsum(counts) - counts
                at = np.arange(counts.sum()) - np.repeat(first - lo, counts)
                pairs = np.unique(np.stack([np.repeat(owner, counts), n[at]], 1), axis=0)
                out.update((int(d), int(t)) for d, t in pairs)
        return out


def leaks(documents: DataFrame, items: DataFrame, most_broadcast: int = MOST_BROADCAST) -> DataFrame:
    """``doc_id, item_id, part, longest, tiles, covered, size, in_order, run``: what each document holds of each item.

    One row per document, item and part ('passage' or 'question') that share a run of cores
    of at least ``run`` code points: 50, or 20 for items in Chinese. Such pairs are tiled
    with tiles of 20 code points or more, so shorter pieces in another order count too.
    Null and shorter texts have no row; repeated documents each have theirs; other columns
    of either table are ignored. Items beyond ``most_broadcast`` code points are joined by
    seed instead of broadcast, seeds of very many documents split over tasks.
    """
    ship_package(documents.sparkSession)
    texts = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()))
    asked = items.select("item_id", "lang", *_PARTS).where(F.col("item_id").isNotNull())
    total = asked.agg(F.sum(sum(F.coalesce(F.length(p), F.lit(0)) for p in _PARTS))).first()[0] or 0
    schema = f"doc_id {dict(texts.dtypes)['doc_id']}, item_id {dict(asked.dtypes)['item_id']}, {_FIELDS}"
    if total <= most_broadcast:
        return _by_broadcast(texts, asked, schema)
    return _by_seed(texts, asked, schema)


def _rows(batch: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*batch) if batch else [()] * len(schema), schema)], schema=schema)


def _arrow(schema: str, df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)


def _by_broadcast(texts: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    # the size was checked; the index is built once and every worker has a copy
    shared = texts.sparkSession.sparkContext.broadcast(Seeds([tuple(r) for r in items.collect()]))
    shape = _arrow(schema, texts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = shared.value
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in cores.blocks(bodies):
                points, offsets = cores.cores(bodies[lo:hi])
                out = []
                for d, t in sorted(seeds.hits(points, offsets)):
                    item_id, part, least = seeds.owner[t]
                    found = measure(seeds.cores[t], points[offsets[d] : offsets[d + 1]], TILE)
                    if found:
                        out.append((ids[lo + d], item_id, *found, part, least))
                yield _rows(out, shape)

    return texts.mapInArrow(run, schema)


def _by_seed(texts: DataFrame, items: DataFrame, schema: str) -> DataFrame:
    def seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                own = Seeds([row])
                for k, (h, n, _) in own.by_length.items():
                    parts = [own.owner[t][1] for t in n]
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([k] * len(h), pa.int32()), pa.array([row[0]] * len(h), batch.schema.field(0).type), pa.array(parts)], names=["seed", "k", "item_id", "part"])

    kind = {"doc": dict(texts.dtypes)["doc_id"], "item": dict(items.dtypes)["item_id"]}
    planted = checkpointed(items.mapInArrow(seeds, f"seed long, k int, item_id {kind['item']}, part string").distinct())
    lengths = sorted({LEAST, LEAST_ZH})
    maps = {k: partials.bit_map(planted.where(F.col("k") == k).select("seed"), lambda b: b.column(0).to_numpy().view(np.uint64), 24) for k in lengths}

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lo, hi in cores.blocks(bodies):
                points, offsets = cores.cores(bodies[lo:hi])
                for k in lengths:
                    h, owner = cores.block_windows(points, offsets, k)
                    maybe = np.flatnonzero(partials.has_bits(maps[k], h))
                    yield pa.RecordBatch.from_arrays([pa.array(h[maybe].view(np.int64)), pa.array([k] * len(maybe), pa.int32()), pa.array([ids[lo + d] for d in owner[maybe]], batch.schema.field(0).type)], names=["seed", "k", "doc_id"])

    shape = _arrow(schema, texts)

    def check(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, item_id, part, lang, item, text in zip(*(c.to_pylist() for c in batch.columns)):
                found = measure(cores.cores([item])[0], cores.cores([text])[0], TILE)
                if found:
                    out.append((doc_id, item_id, *found, part, _least(lang)))
            yield _rows(out, shape)

    seen = checkpointed(texts.mapInArrow(windows, f"seed long, k int, doc_id {kind['doc']}").distinct())
    met = spread_join(seen.withColumnRenamed("k", "length"), planted, "seed", hot_values(seen, "seed")).where("length = k")
    pairs = checkpointed(met.select("doc_id", F.struct("item_id", "part").alias("named")).distinct())
    pairs = pairs.withColumn("name", F.xxhash64("named"))
    named = items.select("item_id", "lang", F.explode(F.array(*(F.struct(F.lit(p).alias("part"), F.col(p).alias("item")) for p in _PARTS))).alias("x")).select("item_id", "lang", "x.*")
    named = named.withColumn("name", F.xxhash64(F.struct("item_id", "part")))
    both = spread_join(pairs.join(texts, "doc_id"), named, "name", hot_values(pairs, "name")).where("named.item_id = item_id and named.part = part")
    return both.select("doc_id", "item_id", "part", "lang", "item", "text").mapInArrow(check, schema)


def leaked(measured: DataFrame, least: float = 0.0, full: float = 0.9) -> DataFrame:
    """The leaks whose longest tile is a run of the item's language and whose tiles cover ``least`` of the item or more.

    Adds coverage and verdict: 'full', 'reordered' (full, but in another order) or 'part'.
    """
    coverage = F.col("covered") / F.col("size")
    kept = measured.where((F.col("longest") >= F.col("run")) & (coverage >= least))
    return kept.withColumn("coverage", F.round(coverage, 4)).withColumn("verdict", F.when(coverage < full, "part").when(F.col("in_order"), "full").otherwise("reordered"))
