"""Vectorised text cores and shingle hashes (numpy, used inside Arrow stages).

The *core* of a text is its lower-case form with everything but Unicode letters
and digits removed. All functions take a block of texts at once: the code points
of a whole block form one array, so no Python code runs per character.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np

_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15)
#: Code points in one block; a longer text forms a block of its own.
BLOCK = 1_000_000


@lru_cache(maxsize=1)
def keep_table() -> np.ndarray:
    """True at each code point that is a letter or digit."""
    return np.fromiter((chr(i).isalnum() for i in range(0x110000)), bool, 0x110000)


def blocks(texts: list[str | None], limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``limit`` code points."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def cores(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all cores in a row, and where each core begins (n + 1 offsets)."""
    lowered = [t.lower() if t else "" for t in texts]
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in lowered], out=bounds[1:])
    points = code_points("".join(lowered))
    kept = keep_table()[points]
    count = np.zeros(len(points) + 1, np.int64)
    np.cumsum(kept, out=count[1:])
    return points[kept], count[bounds]


def core_text(text: str | None) -> str:
    points, _ = cores([text])
    return points.tobytes().decode("utf-32-le", "surrogatepass")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(32))


def window_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit polynomial hash of each window of ``k`` code points, by doubling."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, have = points.astype(np.uint64) + _U(1), 1
    out, done = None, 0
    base = BASE
    bit = 1
    while True:
        if k & bit:
            if out is None:
                out = power
            else:
                m = len(points) - (done + have) + 1
                out = out[:m] * base + power[done : done + m]
            done += have
        bit <<= 1
        if bit > k:
            break
        m = len(points) - 2 * have + 1
        power = power[:m] * base + power[have : have + m]
        base = _U(int(base) ** 2 & 0xFFFFFFFFFFFFFFFF)
        have *= 2
    return mix(out[:n])


def block_windows(points: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows that lie within one core, and the core's index for each."""
    h = window_hashes(points, k)
    counts = np.maximum(np.diff(offsets) - (k - 1), 0)
    if not len(h) or not counts.sum():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    at = np.arange(len(owner)) - first[owner] + offsets[:-1][owner]
    return h[at], owner


def sorted_distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; for short arrays several times as fast as the general function."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def distinct_windows(text: str, k: int) -> np.ndarray:
    """Sorted distinct window hashes of a text that is a core already."""
    return sorted_distinct(window_hashes(code_points(text), k))


def overlap(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted arrays of distinct values; 0 if both are empty."""
    both = len(a) + len(b)
    if not both:
        return 0.0
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (both - common)


def text_id(points: np.ndarray, salt: bytes = b"") -> bytes:
    """A 128-bit identity of a core; ``salt`` has up to 64 bytes."""
    return hashlib.blake2b(points.tobytes(), digest_size=16, key=salt).digest()


def group_salt(name: str | None) -> bytes:
    """32 bytes for a whole group name; a null one differs from an empty one."""
    return hashlib.blake2b(b"" if name is None else b"=" + name.encode("utf-8", "surrogatepass"), digest_size=32).digest()


@lru_cache(maxsize=1 << 17)
def _word_hash(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


def word_shingles(text: str | None, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words (letters and digits, lower case).

    A text with fewer words has one shingle of all of them; CJK characters are words of their own.
    """
    words = words_of(text)
    hashes = np.fromiter((_word_hash(w) for w in words), np.uint64, len(words))
    return sorted_distinct(window_hashes(hashes, min(n, len(words)))) if words else hashes


def words_of(text: str | None) -> list[str]:
    import regex

    return regex.findall(r"[\p{Han}\p{Hiragana}\p{Katakana}]|[\p{L}\p{Nd}]+", (text or "").lower())
