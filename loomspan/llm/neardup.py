"""Near-duplicate records by HyperMinHash banding.

Records are reduced to *classes* of equal core within a group: exact copies share one
sketch and are never paired with each other. Each class has one sketch row. Bands of its
compressed registers name candidate pairs of classes, in blocks where a band is hot; small
sets, whose registers would be empty, have exact keys instead. A collision-corrected
estimate over a few other registers, which travel with each band, drops chance collisions
inside the join; one over both whole sketches drops most others; what is left is verified
on whole texts. In joins a class goes by its *handle*, the first 62 bits of its 128-bit
identity; two classes of one handle only cost a comparison.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import hot_values, spread_join
from ..session import checkpointed, ship_package, spread
from . import cores, partials, sketch

#: Candidate filters use a map of 2 ** 22 bits (512 KiB), whatever the input.
_FILTER_BITS = 22
#: Most classes of one key that one task compares with each other.
BLOCK = 2048
#: Hot keys are looked for among one class in SAMPLE; it only decides on blocks, not on rows.
SAMPLE, SEEN = 64, 8
#: Hot keys are noted by slot: 2 ** 16 numbers, whatever the input.
_SLOTS = 16
#: Shingle hashes kept while pairs are verified.
_KEPT = 4_000_000


@dataclass
class Block:
    """Some rows (grp, key, text): their cores in a row with offsets, and class identities (None: too short)."""

    groups: list
    keys: list
    texts: list
    points: np.ndarray
    offsets: np.ndarray
    ids: list

    def core(self, i: int) -> np.ndarray:
        return self.points[self.offsets[i] : self.offsets[i + 1]]

    def fresh(self, seen: set) -> list[int]:
        """Rows whose class isn't in ``seen``, which they join."""
        out = []
        for i, own in enumerate(self.ids):
            if own is not None and own not in seen:
                seen.add(own)
                out.append(i)
        return out


def handles(ids: list[bytes]) -> np.ndarray:
    """The first 62 bits of identities; two low bits are free for a side."""
    return np.frombuffer(b"".join(i[:8] for i in ids), np.int64) & ~np.int64(3)


def _spread(ids: np.ndarray) -> np.ndarray:
    return cores.mix(ids.view(np.uint64))


def read(batches: Iterable[pa.RecordBatch], least: int, words: int) -> Iterator[Block]:
    salts: dict[str | None, bytes] = {}
    for batch in batches:
        groups, keys, texts = (c.to_pylist() for c in batch.columns[:3])
        for lo, hi in cores.blocks(texts):
            points, offsets = cores.cores(texts[lo:hi])
            block = Block(groups[lo:hi], keys[lo:hi], texts[lo:hi], points, offsets, [None] * (hi - lo))
            for i in np.flatnonzero(np.diff(offsets) >= max(least, 1)):
                g = block.groups[i]
                if g not in salts:
                    if len(salts) > 100_000:
                        salts.clear()
                    salts[g] = cores.group_salt(g)
                # word boundaries are no part of a core
                own = cores.code_points(" ".join(cores.words_of(block.texts[i]))) if words else block.core(i)
                block.ids[i] = cores.text_id(own, salts[g])
            yield block


def _usable(records: DataFrame) -> DataFrame:
    return spread(records.select("grp", "key", "text").where(F.col("key").isNotNull() & F.col("text").isNotNull()))


def members(records: DataFrame, least: int = 100, words: int = 0) -> DataFrame:
    """``grp, key, cid``: each distinct record with the class of its text.

    ``records`` has grp, key and text. Records with a null key, or whose core is shorter
    than ``least`` code points, are left out; rows repeated with one key count once.
    """
    ship_package(records.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in read(batches, least, words):
            ok = [i for i, own in enumerate(block.ids) if own is not None]
            yield pa.RecordBatch.from_arrays(
                [pa.array([block.groups[i] for i in ok], pa.string()), pa.array([block.keys[i] for i in ok], pa.string()), pa.array([block.ids[i] for i in ok], pa.binary())], names=["grp", "key", "cid"]
            )

    return _usable(records).mapInArrow(run, "grp string, key string, cid binary").distinct()


_SKETCH = "handle long, salt long, n int, regs binary, keys binary, sides binary"


def sketches(records: DataFrame, threshold: float, k: int = 8, least: int = 100, words: int = 0) -> DataFrame:
    """One row per class: its handle, its number of shingles, its registers, and its exact keys with their sides if it is small.

    Tasks note a class once each; only sketches noted by several tasks move, to be made one.
    """
    drawn = checkpointed(_drawn(records, threshold, k, least, words))
    several = checkpointed(drawn.groupBy("handle").agg(F.count("*").alias("n")).where("n > 1").select("handle"))
    repeated = partials.bit_map(several, lambda batch: _spread(batch.column(0).to_numpy()), partials.bits_for(16 * several.count(), 28, 16))
    return _held(drawn, repeated, False).unionByName(checkpointed(_held(drawn, repeated, True).distinct()))


def _held(drawn: DataFrame, table: np.ndarray, inside: bool) -> DataFrame:
    """The sketches whose handles are perhaps in a bit map, or are certainly not."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(partials.has_bits(table, _spread(batch.column(0).to_numpy())) == inside))

    return drawn.mapInArrow(run, _SKETCH)


def _drawn(records: DataFrame, threshold: float, k: int, least: int, words: int) -> DataFrame:
    ship_package(records.sparkSession)
    both = sketch.SMALL / threshold

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        salts: dict[str | None, int] = {}
        for block in read(batches, least, words):
            fresh = block.fresh(seen)
            if not fresh:
                continue
            if words:
                sets = [cores.word_shingles(block.texts[i], words) for i in fresh]
                sizes = np.array([len(s) for s in sets])
                hashes = np.concatenate(sets)
            else:
                every, owner = cores.block_windows(block.points, block.offsets, k)
                counts = np.maximum(np.diff(block.offsets) - (k - 1), 0)
                chosen = np.zeros(len(block.ids), bool)
                chosen[fresh] = True
                hashes, sizes = every[chosen[owner]], counts[fresh]
            ends = np.cumsum(sizes)
            regs = sketch.registers(hashes, np.repeat(np.arange(len(fresh)), sizes), len(fresh))
            for g in {block.groups[i] for i in fresh} - salts.keys():
                salts[g] = int.from_bytes(cores.group_salt(g)[:8], "little", signed=True)
            # a longer text may have few distinct windows too; its minima are then far from 0
            few = (sizes <= 4 * both) | (sketch.zeros(regs).mean(1) < np.log2(both / sketch.BUCKETS) + 1.5)
            n, keys, sides, bodies = [], [], [], []
            for j, (end, size) in enumerate(zip(ends, sizes)):
                own = hashes[end - size : end] if words else cores.sorted_distinct(hashes[end - size : end]) if few[j] else None
                n.append(size if own is None else len(own))
                a, b = sketch.exact_keys(own, threshold) if 0 < n[-1] <= both else (b"", b"")
                keys.append(bytes(a))
                sides.append(bytes(b))
                bodies.append(regs[j].tobytes() if n[-1] > sketch.SMALL else b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(handles([block.ids[i] for i in fresh])), pa.array([salts[block.groups[i]] for i in fresh], pa.int64()), pa.array(n, pa.int32()), *(pa.array(c, pa.binary()) for c in (bodies, keys, sides))],
                names=["handle", "salt", "n", "regs", "keys", "sides"],
            )

    return _usable(records).mapInArrow(run, _SKETCH)


def key_rows(batch: pa.RecordBatch, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Key, handle, witness and side of every row by which the sketches of a batch meet others."""
    handle, salt = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
    regs, keys, sides = (batch.column(i).to_pylist() for i in (3, 4, 5))
    large = np.array([i for i, r in enumerate(regs) if r], np.int64)
    found, witness, holds = sketch.bands(np.frombuffer(b"".join(regs[i] for i in large), np.uint16).reshape(len(large), sketch.REGISTERS), salt[large], bands)
    owner = np.repeat(large, holds.sum(1))
    counts = [len(s) for s in sides]
    small = np.repeat(np.arange(len(sides)), counts)
    exact = cores.mix(np.frombuffer(b"".join(keys), np.uint64) ^ salt[small]).view(np.int64)
    return (
        np.concatenate([found[holds], exact]),
        handle[np.concatenate([owner, small])],
        np.concatenate([witness[holds], np.zeros(len(small), np.int64)]),
        np.concatenate([np.zeros(len(owner), np.int8), np.frombuffer(b"".join(sides), np.int8)]),
    )


def hot_blocks(drawn: DataFrame, bands: int) -> np.ndarray:
    """Into how many blocks the classes of a key are cut, by slot of the key: 1 but where a key is hot.

    Classes are drawn by their handles. A hot key that isn't seen costs time, not rows.
    """

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(_spread(batch.column(0).to_numpy()) % np.uint64(SAMPLE) == 0))
            if part.num_rows:
                key, _, _, side = key_rows(part, bands)
                yield pa.RecordBatch.from_arrays([pa.array(key[side == 0])], names=["key"])

    found = drawn.mapInArrow(sampled, "key long").groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN)
    by_slot = found.groupBy(F.shiftrightunsigned("key", 64 - _SLOTS).alias("slot")).agg(F.max("n").alias("n"))
    out = np.ones(1 << _SLOTS, np.int64)
    for slot, n in by_slot.collect():  # at most 2 ** _SLOTS rows
        out[slot] = -(-n * SAMPLE // BLOCK)
    return out


def agreeing(a: Column, b: Column) -> Column:
    """How many of the 16 packed 4-bit witnesses are equal."""
    x = a.bitwiseXOR(b)
    x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
    x = x.bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseAND(F.lit(0x1111111111111111))
    return F.lit(sketch.WITNESSES) - F.bit_count(x)


def placed(drawn: DataFrame, threshold: float) -> DataFrame:
    """``key, handle, witness``: the rows that meet by key; the side is in the two low bits of the handle.

    The classes of a hot key are cut in blocks and each pair of blocks is a key of its
    own, so no task compares more than two blocks.
    """
    bands = sketch.bands_for(threshold)
    blocks = hot_blocks(drawn, bands)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, handle, witness, side = key_rows(batch, bands)
            many = np.where(side == 0, blocks[(key.view(np.uint64) >> np.uint64(64 - _SLOTS)).astype(np.int64)], 1)
            row = np.repeat(np.arange(len(key)), many)
            if len(row) > len(key):
                other = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                many = many[row]
                own = (_spread(handle)[row] // np.uint64(SAMPLE) % many.astype(np.uint64)).astype(np.int64)
                low, high = np.minimum(own, other), np.maximum(own, other)
                apart = cores.mix(key[row].view(np.uint64) ^ cores.mix((low * (1 << 31) + high + 1).astype(np.uint64))).view(np.int64)
                key = np.where(many > 1, apart, key[row])
                side = np.where(many > 1, (own < other) * 1 + (own > other) * 2, side[row]).astype(np.int8)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(handle[row] | side), pa.array(witness[row])], names=["key", "handle", "witness"])

    return drawn.mapInArrow(run, "key long, handle long, witness long")


def candidates(drawn: DataFrame, threshold: float) -> DataFrame:
    """``a, b`` (a < b): handles of sketches that share a key and whose estimate from the witnesses reaches the threshold, less its error."""
    rows = placed(drawn, threshold)
    left, right = rows.alias("l"), rows.alias("r")
    side = F.col("l.handle").bitwiseXOR(F.col("r.handle")).bitwiseAND(F.lit(3)) != 0
    met = (F.col("l.key") == F.col("r.key")) & (F.col("l.handle") < F.col("r.handle")) & ((F.col("l.handle").bitwiseAND(F.lit(3)) == 0) | side)
    near = left.join(right, met).where(agreeing(F.col("l.witness"), F.col("r.witness")) >= sketch.least_agreeing(threshold))
    bare = lambda c: F.col(c).bitwiseAND(F.lit(-4))
    return near.select(bare("l.handle").alias("a"), bare("r.handle").alias("b")).where("a <> b").distinct()


def estimated(pairs: DataFrame, drawn: DataFrame, threshold: float) -> DataFrame:
    """Those of the candidates whose sketches' estimate reaches the threshold, less its error.

    Pairs with a small set, which have met by an exact key, need no estimate; their sizes must allow the threshold.
    """
    least = sketch.least_estimate(threshold)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m = (batch.column(i).to_numpy() for i in (0, 1, 2, 4))
            x, y = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            keep = np.minimum(n, m) >= np.maximum(n, m) * threshold - 1e-9  # both are exact where one set is small
            judged = np.array([i for i in range(len(a)) if x[i] and y[i]], np.int64)
            both = [np.frombuffer(b"".join(s[i] for i in judged), np.uint16).reshape(len(judged), sketch.REGISTERS) for s in (x, y)]
            keep[judged] = sketch.estimates(*both) >= least
            yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    wanted = _wanted(pairs)
    some = _held(drawn, wanted, True)
    side = lambda one, n, regs: some.select(F.col("handle").alias(one), F.col("n").alias(n), F.col("regs").alias(regs))
    total = pairs.count()
    both = spread_join(spread_join(pairs, side("a", "n", "x"), "a", hot_values(pairs, "a", total=total)), side("b", "m", "y"), "b", hot_values(pairs, "b", total=total))
    return both.select("a", "b", "n", "x", "m", "y").mapInArrow(run, "a long, b long")


def _wanted(pairs: DataFrame) -> np.ndarray:
    """A bit map of the handles in some pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("handle"))
    return partials.bit_map(ends, lambda batch: _spread(batch.column(0).to_numpy()), _FILTER_BITS)


def verified(pairs: DataFrame, records: DataFrame, threshold: float, k: int = 8, least: int = 100, words: int = 0) -> DataFrame:
    """``a, b, similarity``: identities of the classes of each pair (a, b of handles) whose whole texts reach the threshold.

    ``pairs`` should be checkpointed: it is read several times. Only texts of classes in
    some pair move, found by a bit map of fixed size; pairs of a class in very many are
    split over tasks.
    """
    ship_package(records.sparkSession)
    wanted = _wanted(pairs)

    def bodies(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for block in read(batches, least, words):
            fresh = block.fresh(seen)
            own = handles([block.ids[i] for i in fresh])
            some = np.flatnonzero(partials.has_bits(wanted, _spread(own)))
            body = [" ".join(cores.words_of(block.texts[fresh[j]])) if words else block.core(fresh[j]).tobytes().decode("utf-32-le", "replace") for j in some]
            yield pa.RecordBatch.from_arrays([pa.array(own[some]), pa.array([block.ids[fresh[j]] for j in some], pa.binary()), pa.array(body, pa.string())], names=["handle", "cid", "body"])

    texts = _usable(records).mapInArrow(bodies, "handle long, cid binary, body string").distinct()
    side = lambda one, cid, body: texts.select(F.col("handle").alias(one), F.col("cid").alias(cid), F.col("body").alias(body))
    total = pairs.count()
    both = spread_join(spread_join(pairs, side("a", "ca", "x"), "a", hot_values(pairs, "a", total=total)), side("b", "cb", "y"), "b", hot_values(pairs, "b", total=total))
    return both.select("ca", "x", "cb", "y").mapInArrow(lambda batches: compared(batches, threshold, k, words), "a binary, b binary, similarity double")


def compared(batches: Iterable[pa.RecordBatch], threshold: float, k: int, words: int = 0) -> Iterator[pa.RecordBatch]:
    """The overlap of two bodies, for rows of identity and body of each; a body's shingles are kept for its next pairs."""
    known: dict[bytes, np.ndarray] = {}
    held = 0

    def shingles(cid: bytes, body: str) -> np.ndarray:
        nonlocal held
        if cid not in known:
            if held > _KEPT:
                known.clear()
                held = 0
            known[cid] = cores.word_shingles(body, words) if words else cores.distinct_windows(body, k)
            held += len(known[cid])
        return known[cid]

    for batch in batches:
        a, x, b, y = (c.to_pylist() for c in batch.columns)
        values = [cores.overlap(shingles(*s), shingles(*t)) for s, t in zip(zip(a, x), zip(b, y))]
        ok = [i for i, v in enumerate(values) if v >= threshold]
        yield pa.RecordBatch.from_arrays(
            [pa.array([a[i] for i in ok], pa.binary()), pa.array([b[i] for i in ok], pa.binary()), pa.array([values[i] for i in ok], pa.float64())], names=["a", "b", "similarity"]
        )


def similar_classes(records: DataFrame, threshold: float = 0.8, k: int = 8, least: int = 100, words: int = 5) -> DataFrame:
    """``a, b, similarity``: pairs of classes of different texts of one group at or above the threshold.

    ``words=0`` compares windows of ``k`` code points of the cores; otherwise runs of
    ``words`` words. Empty, null and too short texts have no class. An empty input gives
    an empty result. Columns beside grp, key and text are ignored.
    """
    drawn = sketches(records, threshold, k, least, words)
    found = checkpointed(candidates(drawn, threshold))
    near = checkpointed(estimated(found, drawn, threshold))
    return verified(near, records, threshold, k, least, words)


def connected(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, root``: the least node of each connected component of ``edges (a, b)``.

    Large-star and small-star steps in turn; each step is checkpointed, so the plan stays
    short and a lost executor costs one step. Every node of an edge has one row. A root
    with a large share of all edges is split over tasks in the joins.
    """
    current = checkpointed(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    before = None
    for _ in range(rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        larger = both.where("v > u")
        large = checkpointed(spread_join(larger, low, "u", hot_values(larger, "u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", hot_values(large, "u")).select(F.col("v").alias("x"), F.col("m").alias("v"), "u")
        current = checkpointed(small.select("u", "v").unionByName(small.where("x <> v").select(F.col("x").alias("u"), "v")).where("u > v").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()


def near_groups(records: DataFrame, threshold: float = 0.8, k: int = 8, least: int = 100, words: int = 5) -> DataFrame:
    """``grp, key, class_id, group_id, n_links``: one row per record.

    Records with one ``class_id`` have the same text; ``group_id`` joins classes linked,
    directly or by others, by near-duplicate pairs; ``n_links`` counts the direct links of
    the class. Ids are 128-bit values as 32 hexadecimal digits. Records without a class
    (null, empty, too short) have no row.
    """
    links = checkpointed(similar_classes(records, threshold, k, least, words))
    degree = links.select(F.explode(F.array("a", "b")).alias("cid")).groupBy("cid").agg(F.count("*").alias("n_links"))
    of_class = degree.join(connected(links).select(F.col("node").alias("cid"), "root"), "cid")
    own = checkpointed(members(records, least, words))
    named = spread_join(own, of_class, "cid", hot_values(own, "cid"), "left")
    text = lambda c: F.lower(F.hex(c))
    return named.select("grp", "key", text("cid").alias("class_id"), text(F.coalesce("root", "cid")).alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
