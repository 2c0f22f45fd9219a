"""Content-defined cutting of oversized texts at natural boundaries."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, spread
from . import cores

#: Punctuation at which a text may be cut, beside white space.
PUNCTUATION = ",.;:!?、。，；：！？"
#: Code points of the rolling hash, and how many positions share a landmark on average.
WINDOW, SPACING = 16, 128


@lru_cache(maxsize=1)
def boundary_table() -> np.ndarray:
    table = np.fromiter((chr(i).isspace() for i in range(0x110000)), bool, 0x110000)
    table[[ord(c) for c in PUNCTUATION]] = True
    return table


def cut(text: str | None, limit: int, overlap: int) -> tuple[list[int], list[int], list[str]]:
    """Starts, ends and kinds of a text's pieces, in code points.

    A cut falls where a rolling hash of the text before it marks a position, moved to the
    nearest natural boundary; both depend on the text near the cut only, so an edit changes
    the pieces around it and the cuts fall into step again. Cuts lie between a quarter of
    the free length (limit less overlap) and that length apart; if no boundary lies there,
    one nearer or as far as the limit is taken and the overlap shrinks as needed, and only
    a stretch longer than the limit without any boundary is cut by force. Each piece
    repeats the last ``overlap`` code points before its cut. Kinds: 'natural', 'forced' or,
    for the last piece, 'end'. A null or empty text has no piece.
    """
    if limit < 2 or not 0 <= overlap < limit:
        raise ValueError("needs limit >= 2 and 0 <= overlap < limit")
    if not text:
        return [], [], []
    n = len(text)
    if n <= limit:
        return [0], [n], ["end"]
    points = cores.code_points(text)
    marks = np.flatnonzero(cores.window_hashes(points, WINDOW) % np.uint64(SPACING) == 0) + WINDOW
    at = np.flatnonzero(boundary_table()[points])
    places = np.unique(np.concatenate([at, at + 1]))  # before or after a boundary
    free = limit - overlap
    least = max(1, free // 4)
    starts, ends, kinds = [], [], []
    last = 0
    while True:
        start = max(0, last - overlap)
        if n - start <= limit:
            starts.append(start)
            ends.append(n)
            kinds.append("end")
            return starts, ends, kinds
        reach = last + (limit if last == 0 else free)
        low, high = last + least, reach
        i = np.searchsorted(marks, low)
        goal = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        a, b = np.searchsorted(places, low), np.searchsorted(places, high, "right")
        kind = "natural"
        if a < b:
            j = int(np.searchsorted(places[a:b], goal))
            near = places[a:b][max(0, j - 1) : j + 1]
            end = int(near[np.argmin(np.abs(near - goal))])
        else:
            b = np.searchsorted(places, last + limit, "right")
            a = np.searchsorted(places, last, "right")
            if a < b:
                later = places[a:b][places[a:b] > high]
                end = int(later[0]) if len(later) else int(places[b - 1])
            elif n - last <= limit:
                starts.append(n - limit)  # what is left fits with less overlap
                ends.append(n)
                kinds.append("end")
                return starts, ends, kinds
            else:
                end, kind = goal, "forced"
        starts.append(max(start, end - limit))
        ends.append(end)
        kinds.append(kind)
        last = end


def pieces(items: DataFrame, overlap: int = 64, share: float = 0.1) -> DataFrame:
    """One row per oversized item: its own columns without text, and arrays starts, ends, kinds.

    ``items`` has text, size and limit (ints) and any other columns; an item is oversized if
    its size, or the length of its text where size is null, is over its limit. The overlap is
    ``overlap`` or ``share`` of the limit, whichever is less. Null texts and limits have no row.
    """
    ship_package(items.sparkSession)
    over = F.coalesce(F.col("size"), F.length("text")) > F.col("limit")
    others = [c for c in items.columns if c not in ("text", "size")]
    fields = ", ".join(f"`{c}` {dict(items.dtypes)[c]}" for c in others)
    names = [*others, "starts", "ends", "kinds"]
    width = others.index("limit")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, limits = batch.column(batch.num_columns - 1).to_pylist(), batch.column(width).to_pylist()
            made = [cut(t, m, min(overlap, int(m * share))) for t, m in zip(texts, limits)]
            lists = [pa.array([m[0] for m in made], pa.list_(pa.int32())), pa.array([m[1] for m in made], pa.list_(pa.int32())), pa.array([m[2] for m in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *lists], names=names)

    return spread(items.where(over & F.col("text").isNotNull()).select(*others, "text")).mapInArrow(run, f"{fields}, starts array<int>, ends array<int>, kinds array<string>")


def cut_kind(kinds: Column) -> Column:
    """'forced' if any piece was cut by force, else 'natural'."""
    return F.when(F.array_contains(kinds, "forced"), "forced").otherwise("natural")


def exploded(cut_items: DataFrame) -> DataFrame:
    """One row per piece: piece, piece_start, piece_end, overlap, kind.

    overlap is how much the piece repeats of the one before it: what was asked for, or less
    where a boundary lay beyond the free length.
    """
    before = F.concat(F.slice("starts", 1, 1), F.slice("ends", F.lit(1), F.greatest(F.size("ends") - 1, F.lit(0))))
    zipped = F.posexplode(F.arrays_zip("starts", "ends", "kinds", before.alias("before"))).alias("piece", "p")
    others = [c for c in cut_items.columns if c not in ("starts", "ends", "kinds")]
    start, end = F.col("p.starts").alias("piece_start"), F.col("p.ends").alias("piece_end")
    return cut_items.select(*others, zipped).select(*others, "piece", start, end, (F.col("p.before") - F.col("p.starts")).alias("overlap"), F.col("p.kinds").alias("kind"))
