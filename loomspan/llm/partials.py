"""Fixed-size tables gathered from all rows: bit maps and counters.

Each task folds its rows into a partial table and emits it by segment, compressed;
one group per segment merges the partials. Only the merged table, whose size is the
parameter, reaches the driver, however many rows or tasks there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

_PARTIAL = "segment int, body binary"
_SEGMENTS = 16


def _emit(parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary())], names=["segment", "body"])


def _merge(df: DataFrame, fold: Callable[[np.ndarray, bytes], None], size: int, dtype: str, last: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """``last`` turns a merged segment into bytes of its own before it leaves its task."""
    width = size // _SEGMENTS

    def merge(groups: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, np.ndarray] = {}
        for batch in groups:
            for segment, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                tables.setdefault(segment, np.zeros(width, dtype))
                fold(tables[segment], zstandard.decompress(body))
        if tables:
            yield _emit([(s, zstandard.compress((last(t) if last else t).tobytes())) for s, t in tables.items()])

    out = np.zeros(size, "u1" if last else dtype)
    merged = df.repartition(_SEGMENTS, "segment").mapInArrow(merge, _PARTIAL)
    for segment, body in merged.collect():  # at most _SEGMENTS rows of a fixed size
        out[segment * width : (segment + 1) * width] = np.frombuffer(zstandard.decompress(bytes(body)), out.dtype)
    return out


def bit_map(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int = 24) -> np.ndarray:
    """A map of ``2 ** bits`` bits (as bytes of bits) with a bit set for each 64-bit hash of any row.

    Two hash values fall on one bit now and then, so a set bit means "perhaps"; a
    clear bit means "certainly not". More rows than bits only make it less selective.
    """
    size = 1 << bits
    width = size // _SEGMENTS

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size // 8, np.uint8)
        for batch in batches:
            set_bits(own, hashes(batch), bits)
        parts = []
        for s in range(_SEGMENTS):
            piece = own[s * width // 8 : (s + 1) * width // 8]
            if piece.any():
                parts.append((s, zstandard.compress(piece.tobytes())))
        if parts:
            yield _emit(parts)

    def fold(table: np.ndarray, body: bytes) -> None:
        np.bitwise_or(table, np.frombuffer(body, np.uint8), out=table)

    return _merge(df.mapInArrow(partial, _PARTIAL), fold, size // 8, "u1")


def set_bits(table: np.ndarray, hashes: np.ndarray, bits: int) -> None:
    at = np.unique(hashes.astype(np.uint64) >> np.uint64(64 - bits))
    np.bitwise_or.at(table, at >> np.uint64(3), (np.uint8(1) << (at & np.uint64(7)).astype(np.uint8)))


def has_bits(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each hash, whether its bit is set."""
    bits = len(table).bit_length() + 2
    at = hashes.astype(np.uint64) >> np.uint64(64 - bits)
    return (table[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0


def grades(counts: np.ndarray) -> np.ndarray:
    """Counts on a scale of 256 grades, eight to each doubling."""
    return np.minimum(255, np.log2(counts + 1) * 8).astype(np.uint8)


def counters(df: DataFrame, hashes: Callable[[pa.RecordBatch], np.ndarray], bits: int = 22) -> np.ndarray:
    """How many hashes of all rows fall into each of ``2 ** bits`` slots, as grades."""
    size = 1 << bits
    width = size // _SEGMENTS

    def partial(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(size, np.uint32)
        for batch in batches:
            at, count = np.unique(hashes(batch) >> np.uint64(64 - bits), return_counts=True)
            own[at] += count.astype(np.uint32)
        if own.any():
            yield _emit([(s, zstandard.compress(own[s * width : (s + 1) * width].tobytes(), 1)) for s in range(_SEGMENTS)])

    def fold(table: np.ndarray, body: bytes) -> None:
        table += np.frombuffer(body, np.uint32)

    return _merge(df.mapInArrow(partial, _PARTIAL), fold, size, "i8", grades)


def bits_for(size: int, most: int = 26, least: int = 10) -> int:
    """Bits of a table with a slot or more for each of ``size`` things, within bounds."""
    return min(most, max(least, int(size).bit_length()))
