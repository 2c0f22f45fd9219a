"""HyperMinHash registers: a leading-zero count and mantissa bits per bucket.

A sketch is made of ``PASSES`` passes over a text's shingles. Each pass scrambles the
shingle hashes anew, sends each to one of ``BUCKETS`` buckets by its top bits and keeps
the bucket's minimum, compressed to 16 bits: the number of leading zeros (6 bits) and
the next 10 bits after the leading one. Two registers agree with a probability of the
Jaccard similarity plus a small chance of equal compressed values.
"""

from __future__ import annotations

import numpy as np

from .cores import mix

PASSES, BUCKETS, MANTISSA = 9, 16, 10
REGISTERS = PASSES * BUCKETS
ROWS = 4
BANDS = REGISTERS // ROWS
#: Registers beside a band whose low bits travel with it, for the estimate at a collision.
WITNESSES, WITNESS_BITS = 16, 4
#: The register of an empty bucket.
EMPTY = 65535
#: Sets of up to this many shingles leave many buckets empty and get exact keys instead of bands.
SMALL = 48
#: Standard errors below the threshold at which an estimate over a whole sketch is still kept.
ERRORS = 4.0
_U = np.uint64
_EMPTY = np.uint64((1 << 60) - 1)
_SEEDS = mix(np.arange(1, PASSES + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_STEP = 1 << 20


def registers(hashes: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """The ``(count, REGISTERS)`` 16-bit registers of ``count`` sets of shingle hashes.

    ``owner`` names the set of each hash; repeated hashes don't matter. The register
    of an empty bucket is EMPTY.
    """
    out = np.empty((count, REGISTERS), np.uint16)
    base = owner.astype(np.int64) * BUCKETS
    for j in range(PASSES):
        least = np.full(count * BUCKETS, _EMPTY)
        for at in range(0, len(hashes), _STEP):
            h = mix(hashes[at : at + _STEP] ^ _SEEDS[j])
            np.minimum.at(least, base[at : at + _STEP] + (h >> _U(60)).astype(np.int64), h & _EMPTY)
        out[:, j * BUCKETS : (j + 1) * BUCKETS] = compress(least).reshape(count, BUCKETS)
    return out


def compress(least: np.ndarray) -> np.ndarray:
    """60-bit minima to a 6-bit leading-zero count and ``MANTISSA`` bits."""
    _, exponent = np.frexp(np.maximum(least, _U(1)).astype(np.float64))
    length = exponent.astype(np.int64)
    length -= (least >> np.minimum(length, 60).astype(np.uint64) == 0) & (least >> np.maximum(length - 1, 0).astype(np.uint64) == 0)
    zeros = (60 - length).astype(np.uint64)
    aligned = least << zeros
    mantissa = (aligned >> _U(59 - MANTISSA)) & _U((1 << MANTISSA) - 1)
    value = ((zeros << _U(MANTISSA)) | mantissa).astype(np.uint16)
    value[least == _EMPTY] = EMPTY
    return value


def zeros(regs: np.ndarray) -> np.ndarray:
    """The leading zeros noted in registers, 0 in empty ones."""
    return np.where(regs == EMPTY, 0, regs >> np.uint16(MANTISSA))


def bands_for(threshold: float, miss: float = 1e-3) -> int:
    """How many bands leave a share of at most ``miss`` of pairs at the threshold without a common one, of those there are.

    A pair of similarity s misses all of b bands with a probability of ``(1 - s ** ROWS) ** b``.
    """
    if threshold >= 1:
        return 1
    return min(BANDS, max(1, int(np.ceil(np.log(miss) / np.log(1 - threshold**ROWS))))) if threshold > 0 else BANDS


def bands(regs: np.ndarray, salt: np.ndarray, count: int = BANDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Band keys and witnesses, both ``(sets, count)`` signed 64-bit, and which of them hold.

    A band with an empty register says little and would bring all small sets together: it
    doesn't hold. Sets of different ``salt`` share no key. The witness of a band packs
    ``WITNESS_BITS`` bits of each of ``WITNESSES`` registers outside the band.
    """
    wide = regs.astype(np.uint64)
    keys = np.empty((len(regs), count), np.uint64)
    witness = np.zeros((len(regs), count), np.uint64)
    holds = np.empty((len(regs), count), bool)
    low = wide & _U((1 << WITNESS_BITS) - 1)
    for b in range(count):
        packed = np.zeros(len(regs), np.uint64)
        for r in range(ROWS):
            packed = (packed << _U(16)) | wide[:, b * ROWS + r]
        keys[:, b] = mix(mix(packed) ^ (salt + _U(b + 1)))
        holds[:, b] = (regs[:, b * ROWS : (b + 1) * ROWS] != EMPTY).all(1)
        for w in range(WITNESSES):
            witness[:, b] = (witness[:, b] << _U(WITNESS_BITS)) | low[:, ((b + 1) * ROWS + w) % REGISTERS]
    return keys.view(np.int64), witness.view(np.int64), holds


def tiny(threshold: float) -> int:
    """The largest size of sets whose only partners at the threshold are equal or have one element more."""
    n = 0
    while (n + 1) / (n + 3) < threshold - 1e-9 and n < SMALL:
        n += 1
    return n


def exact_keys(own: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and sides of a small set of sorted distinct hashes; two sets at the threshold share a key.

    Two rows of a key meet if their sides are 0 or differ. Up to ``tiny`` elements partners
    are equal or lack one element of the other: a key of the whole set, and one of each set
    less an element on the other side. Larger ones share one of their first hashes.
    """
    n, least = len(own), tiny(threshold)
    keys, sides = [np.zeros(0, np.uint64)], [np.zeros(0, np.int8)]
    if n <= least / threshold + 1e-9:
        parts = mix(own ^ _SEEDS[0])
        whole = parts.sum(dtype=np.uint64)
        keys += [mix(np.array([whole], np.uint64) ^ _SEEDS[1]), mix(np.concatenate([[whole], whole - parts]) ^ _SEEDS[2])]
        sides += [np.array([0, 1], np.int8), np.full(n, 2, np.int8)]
    if n > least:
        first = own[: n - int(np.ceil(threshold * n - 1e-9)) + 1]
        keys.append(mix(first ^ _SEEDS[3]))
        sides.append(np.zeros(len(first), np.int8))
    return np.concatenate(keys), np.concatenate(sides)


def corrected(agreeing: float, of: int = WITNESSES, bits: int = WITNESS_BITS) -> float:
    """Jaccard estimate from agreeing registers, less the expected chance agreements."""
    chance = 2.0**-bits
    return max(0.0, (agreeing / of - chance) / (1 - chance))


def least_agreeing(threshold: float, of: int = WITNESSES, bits: int = WITNESS_BITS) -> int:
    """Fewest agreeing witnesses at which a pair of that similarity is still kept.

    Two standard errors below the expectation: a pair at the threshold is dropped at
    about one collision in forty, and has several collisions.
    """
    p = threshold + (1 - threshold) * 2.0**-bits
    return int(np.floor(of * p - 2 * np.sqrt(of * p * (1 - p))))


def estimates(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Collision-corrected Jaccard estimates of pairs of whole sketches, row by row."""
    used = (a != EMPTY) | (b != EMPTY)
    n = used.sum(1)
    chance = 2.0 ** -(MANTISSA + 1)
    share = ((a == b) & used).sum(1) / np.maximum(n, 1)
    return np.maximum(0.0, (share - chance) / (1 - chance))


def least_estimate(threshold: float) -> float:
    """The estimate at which a pair of that similarity is still kept: one at it is dropped about once in 30,000 times."""
    return threshold - ERRORS * float(np.sqrt(threshold * (1 - threshold) / REGISTERS))
