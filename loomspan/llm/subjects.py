"""Subject areas of documents: one-versus-rest linear classifiers on hashed word n-grams.

Labels are weak: some are wrong, they name a document's areas, not its sentences', and some
come from a document's source alone. A first fit on whole documents gives each labelled
document's sentences one of its areas, or none; the second fit is on those sentences. A
document has an area if some passage has two sentences whose calibrated score reaches that
area's threshold, or a definition or comment of program code one. What a line looks like
(a call, an assignment, a keyword) is a feature as words are; which area it speaks for is
learned.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpointed, ship_package, spread
from . import cores

#: At most so many labelled documents are fitted on, in an order by hash, and at most so many features of theirs (32 MB).
MOST_LABELLED, MOST_FEATURES = 5000, 8_000_000
#: At most so many subjects; more are an error, not left out.
MOST_SUBJECTS = 1000
#: A source labels its documents if this share of its labelled ones, and so many of them, have one subject.
SOURCE_SHARE, SOURCE_KNOWN = 0.9, 20
_BITS = 22
_WORD = re.compile(r"[㐀-鿿]|[^\W_㐀-鿿]+")
_WORDS_AND_ENDS = re.compile(_WORD.pattern + r"|\n")
_LINE = re.compile(r"\s*(?:\r\n|\n|\r|</p>|<br\s*/?>)\s*", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])[\"”’)*\]\d]*\s+|(?<=[。！？；])\s*")
#: Two sentences on an area count if they are so close together in their passage.
REACH = 6
_GAP = r"[^\S\n]"
_UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORDS = "async def class func public private protected static function import from include".split()
# keywords in lower or in upper case; a capital at the beginning alone is how a sentence begins
_K = {w: f"(?:{w}|{w.upper()})" for w in _WORDS}
_CODE = re.compile(
    rf"^(?:{_GAP}*<[^<>\n]{{1,80}}>)*{_GAP}*(?:(?:{_K['async']}{_GAP}+)?{_K['def']}{_GAP}+\w+{_GAP}*\(|{_K['class']}{_GAP}+\w+[^\n]{{0,80}}[:{{]\s*$|{_K['func']}{_GAP}+\w+{_GAP}*\("
    rf"|(?:{_K['public']}|{_K['private']}|{_K['protected']}|{_K['static']})\b[\w<>\[\], \xa0]*\w\(|{_K['function']}{_GAP}+\w+{_GAP}*\(|{_K['import']}{_GAP}+\w+\.[\w.]+|{_K['from']}{_GAP}+[\w.]+{_GAP}+{_K['import']}{_GAP}+\w|#{_K['include']}{_GAP}+[<\"])",
    re.M,
)
_MARKUP = re.compile(r"<[^<>\n]{1,80}>")
_COMMENT = re.compile(r"//|#(?!#)|/\*|\"\"\"|\'\'\'")
#: A statement beside a comment: the head or end of a block, an assignment, a call or a return; a plain clause that ends in ':' or ';' is none.
_STATEMENT = re.compile(
    r".*\{$|[})\]]+[;,]?$|(?i:else|try|finally):$|(?i:if|elif|while)\b.*(?:[=!<>]=|[<>]|(?i:\bis none|\bin \w+)).*:$|(?i:for)\s+\w+(?:,\s*\w+)*\s+(?i:in)\s+[\w.()]+:$"
    r"|(?i:return)\s+(?:-?\d+|\w+(?:\.\w+)+|[\w.]*\(.*\)|\[.*\]|\w+,\s*\w+|\w+;);?$|(?:\w[\w<>\[\]]*\s+)?[\w.\[\]]+\s*(?::|[-+*/|&])?=(?!=)\s*\S|(?:[a-z_][\w.]*|[A-Z_][A-Z0-9_.]+)\([^()]*\);?$"
)
#: What a line may look like; a feature each.
_SHAPES = {
    "call": r"\w\([^()]*\)",
    "member": r"\w\.\w+\(|\w\[\w*\]",
    "assignment": r"[\w\]]\s*[-+*/|&:]?=(?!=)",
    "comparison": r"[=!<>]=|->|=>",
    "opening": r"[{:]\s*$",
    "ending": r";\s*$",
    "snake": r"\b[^\W_]+(?:_[^\W_]+)+\b",
    "camel": r"\b[a-z]+[A-Z]\w+",
    "keyword": r"(?i)^\s*(?:return|if|for|while|else|elif|try|import|from|def|class|func|public|private|static|int|self)\b",
}
_SHAPE = {name: re.compile(p) for name, p in _SHAPES.items()}
#: A line without any of these has none of the shapes, defines nothing and is no comment.
_HINT = re.compile(r"[{}=;_\[#]|\w\(|//|/\*|\"\"\"|\'\'\'|->|(?i:\bimport\b|\bclass\s+\w)")
#: Least gain of log-odds over the bias at which a sentence speaks for a subject.
EVIDENCE = 1.0


class Unit(NamedTuple):
    """A sentence or a line of code, its shapes, and whether it counts alone."""

    text: str
    shapes: tuple[str, ...] = ()
    alone: bool = False


def passages(text: str | None) -> list[list[Unit]]:
    """The units of each line of a text; lines without letters or digits are dropped.

    A line that defines or imports as program code does, or a comment beside a statement,
    is one unit that counts alone.
    """
    lines = _LINE.split(text or "")
    hinted = [_HINT.search(line) is not None for line in lines]
    told = _alone(lines, hinted) if any(hinted) else [""] * len(lines)
    out = []
    for line, hint, kind in zip(lines, hinted, told):
        shapes: tuple[str, ...] = ()
        if hint:
            plain = _MARKUP.sub("", _UNSEEN.sub("", line))
            shapes = tuple(n for n, p in _SHAPE.items() if p.search(plain))
        if kind:
            units = [Unit(line, (*shapes, kind), True)] if _WORD.search(line) else []
        else:
            units = [Unit(s, shapes) for s in _SENTENCE.split(line) if _WORD.search(s)]
        if units:
            out.append(units)
    return out


def _alone(lines: list[str], hinted: list[bool]) -> list[str]:
    """For each line "definition", "comment" (beside a statement; '#' before lines of prose is none) or an empty string."""
    plain = [_UNSEEN.sub("", line) for line in lines]
    out = ["definition" if hint and _CODE.search(x) else "" for hint, x in zip(hinted, plain)]
    if not any(hint and _COMMENT.search(x) for hint, x in zip(hinted, plain)):
        return out
    bare = [_MARKUP.sub("", x).strip() for x in plain]
    kept = [i for i, x in enumerate(bare) if x]
    comment = [_COMMENT.match(bare[i]) is not None for i in kept]
    for j in range(len(kept) - 1):
        i, k = kept[j], kept[j + 1]
        if comment[j] != comment[j + 1] and _STATEMENT.match(bare[k] if comment[j] else bare[i]):
            at = i if comment[j] else k
            out[at] = out[at] or "comment"
    return out


@lru_cache(maxsize=1 << 18)
def _slot(word: str) -> int:
    """A hash of a word; -1 of a line end."""
    return -1 if word == "\n" else crc32(word.encode("utf-8", "surrogatepass"))


def features(units: list[Unit]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word pairs and shapes of all units in a row, and each unit's number of them."""
    # one pass over all units, whose texts have no line ends
    hashed = np.fromiter(map(_slot, _WORDS_AND_ENDS.findall("".join(f"{u.text}\n" for u in units).lower())), np.int64)
    stops = np.flatnonzero(hashed < 0)
    sizes = np.diff(stops, prepend=-1) - 1
    flat = hashed[hashed >= 0].astype(np.uint64)
    mask = np.uint64((1 << _BITS) - 1)
    single = (flat * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) & mask
    both = np.empty((len(flat), 2), np.int64)
    both[:, 0] = single
    both[:, 1] = ((flat * np.uint64(0xD6E8FEB86659FD93) + np.roll(flat, -1) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(40)) & mask
    ends = np.cumsum(sizes) - 1
    keep = np.ones((len(flat), 2), bool)
    keep[ends[sizes > 0], 1] = False  # the last word of a sentence begins no pair
    ids, sizes = both[keep], np.maximum(2 * sizes - 1, 0)
    shapes = np.array([len(u.shapes) for u in units], np.int64)
    if shapes.any():
        slots = np.array([_slot(f"\0{x}") for u in units for x in u.shapes], np.int64) & ((1 << _BITS) - 1)
        ids = np.insert(ids, np.repeat(np.cumsum(sizes), shapes), slots)
    return ids, sizes + shapes


@dataclass
class Parsed:
    """Texts as numbers: features of all units in a row, how many each unit has, which count alone, units of each passage, passages of each text."""

    ids: np.ndarray
    sizes: np.ndarray
    alone: np.ndarray
    passages: np.ndarray
    texts: np.ndarray

    def units(self) -> np.ndarray:
        """The number of units of each text."""
        return _sums(self.passages[:, None].astype(float), self.texts)[:, 0].astype(np.int64)

    def part(self, i: int) -> "Parsed":
        """One text."""
        p = slice(int(self.texts[:i].sum()), int(self.texts[: i + 1].sum()))
        u = slice(int(self.passages[: p.start].sum()), int(self.passages[: p.stop].sum()))
        f = slice(int(self.sizes[: u.start].sum()), int(self.sizes[: u.stop].sum()))
        return Parsed(self.ids[f], self.sizes[u], self.alone[u], self.passages[p], self.texts[i : i + 1])


def parsed(texts: list[str | None]) -> Parsed:
    split = [passages(t) for t in texts]
    units = [u for doc in split for p in doc for u in p]
    ids, sizes = features(units)
    return Parsed(ids, sizes, np.array([u.alone for u in units], bool), np.array([len(p) for doc in split for p in doc], np.int64), np.array([len(doc) for doc in split], np.int64))


def joined(parts: list[Parsed]) -> Parsed:
    none = [np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64)]
    return Parsed(*(np.concatenate([empty, *(getattr(p, f) for p in parts)]) for f, empty in zip(("ids", "sizes", "alone", "passages", "texts"), none)))


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of ``values`` in groups of the given sizes."""
    out = np.zeros((len(sizes), values.shape[1]))
    some = sizes > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(sizes) - sizes)[some], axis=0)
    return out


def telling(ids: np.ndarray, owner: np.ndarray, targets: np.ndarray, known: int = 4, least: float = 3.5) -> np.ndarray:
    """A place for each feature slot, or 0 for those that tell nothing.

    A slot tells something if it is in ``known`` documents or more and some class's share
    among them is ``least`` standard errors above that class's share of all.
    """
    pairs = np.unique(owner.astype(np.int64) << _BITS | ids)
    ids, row = pairs & ((1 << _BITS) - 1), pairs >> _BITS
    count = np.bincount(ids, minlength=1 << _BITS).astype(float)
    share = targets.mean(0)
    strong = np.zeros(1 << _BITS, bool)
    for c in range(targets.shape[1]):
        hits = np.bincount(ids, targets[row, c], 1 << _BITS)
        error = np.sqrt(np.maximum(count * share[c] * (1 - share[c]), 1e-9))
        strong |= hits - count * share[c] >= least * error
    strong &= count >= known
    places = np.zeros(1 << _BITS, np.int32)
    places[strong] = np.arange(1, strong.sum() + 1)
    return places


@dataclass
class Fit:
    """Logistic weights by place and a bias for one target, by adaptive gradient steps."""

    place: np.ndarray
    row: np.ndarray
    scaled: bool
    rounds: int
    rate: float
    shrink: float

    def __call__(self, target: np.ndarray) -> tuple[np.ndarray, float]:
        n, width = len(target), int(self.place.max(initial=0)) + 1
        sizes = np.bincount(self.row, minlength=n)
        value = (1 / np.sqrt(np.maximum(sizes, 1)) if self.scaled else np.ones(n))[self.row]
        own, bias, past, past_bias = np.zeros(width), -2.0, np.full(width, 1e-8), 1e-8
        for _ in range(self.rounds):
            found = np.bincount(self.row, own[self.place] * value, n) + bias
            error = (1 / (1 + np.exp(-np.clip(found, -30, 30))) - target) / n
            slope = np.bincount(self.place, error[self.row] * value, width) + self.shrink / n * own
            past += slope**2
            own -= self.rate * slope / np.sqrt(past)
            slope = error.sum()
            past_bias += slope**2
            bias -= self.rate * slope / np.sqrt(past_bias)
        own[0] = 0
        return own, bias


def fit(place: np.ndarray, row: np.ndarray, targets: np.ndarray, rounds: int = 15, rate: float = 0.5, shrink: float = 1e-2, scaled: bool = False, spread: Callable = map) -> tuple[np.ndarray, np.ndarray]:
    """One-versus-rest weights by place and biases.

    ``place`` and ``row`` are the telling features and their examples, in order of the
    examples. ``scaled`` divides by the root of an example's number of them.
    """
    done = list(spread(Fit(place.astype(np.int32), row.astype(np.int32), scaled, rounds, rate, shrink), targets.T))
    return np.stack([w for w, _ in done], 1).astype(np.float32), np.array([b for _, b in done])


def score(ids: np.ndarray, sizes: np.ndarray, places: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Sums of the weights of each example's telling features."""
    place = places[ids]
    some = np.flatnonzero(place)
    row = np.repeat(np.arange(len(sizes)), sizes)[some]
    return _sums(weights[place[some]], np.bincount(row, minlength=len(sizes)))


@dataclass
class Model:
    subjects: list[str]
    places: np.ndarray
    weights: np.ndarray
    biases: np.ndarray
    thresholds: np.ndarray

    def __getstate__(self) -> dict:
        at = np.flatnonzero(self.places)
        return self.__dict__ | {"places": (at.astype(np.int32), self.places[at])}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        at, place = state["places"]
        self.places = np.zeros(1 << _BITS, np.int32)
        self.places[at] = place

    def documents(self, texts: Parsed) -> np.ndarray:
        """Each text's score for each subject: its best passage's second best unit nearby, or best unit that counts alone.

        A unit speaks for the subject it scores highest on alone. An untrained model has no scores.
        """
        out = np.full((len(texts.texts), len(self.subjects)), -np.inf)
        if not len(texts.sizes) or not self.subjects:
            return out
        raw = score(texts.ids, texts.sizes, self.places, self.weights) + self.biases
        best, at = raw.argmax(1), np.arange(len(raw))
        own = np.full(raw.shape, -np.inf)
        own[at, best] = np.where(raw[at, best] >= self.biases[best] + EVIDENCE, raw[at, best], -np.inf)
        spoke = np.isfinite(own[at, best])
        ends = np.cumsum(texts.passages)
        told = np.concatenate([[0], np.cumsum(spoke)])
        alone = np.concatenate([[0], np.cumsum(spoke & texts.alone)])
        first = ends - texts.passages
        several, single = told[ends] - told[first] > 1, alone[ends] > alone[first]
        owner = np.repeat(np.arange(len(texts.texts)), texts.texts)
        for p in np.flatnonzero(several | single):
            block, i = own[first[p] : ends[p]], owner[p]
            if several[p]:
                out[i] = np.maximum(out[i], _second(block))
            if single[p]:
                out[i] = np.maximum(out[i], block[texts.alone[first[p] : ends[p]]].max(0))
        return out


def _second(own: np.ndarray) -> np.ndarray:
    """For each column, the best of the lesser scores of two rows at most REACH apart."""
    out = np.full(own.shape[1], -np.inf)
    for step in range(1, min(REACH, len(own) - 1) + 1):
        out = np.maximum(out, np.minimum(own[:-step], own[step:]).max(0))
    return out


def train(texts: Parsed, named: list[list[str]], weak: list[bool], subjects: list[str], held: int = 5, spread: Callable = map) -> Model:
    """A model from texts and the subjects of each; every ``held``-th text only sets the thresholds.

    Texts with ``weak`` labels, which a source gave, are examples of the fits, but neither
    decide which features tell something nor set thresholds. The fits of one round, one per subject, don't depend on each other: ``spread`` maps them.
    """
    truth = np.array([[s in own for s in subjects] for own in named], float).reshape(len(named), len(subjects))
    sure = ~np.array(weak, bool)
    rest = (np.arange(len(named)) % held == held - 1) & sure
    model = Model(subjects, np.zeros(1 << _BITS, np.int32), np.zeros((1, len(subjects)), np.float32), np.full(len(subjects), -1.0), np.zeros(len(subjects)))
    units = texts.units()
    text = np.repeat(np.arange(len(named)), units)  # of each unit
    unit = np.repeat(np.arange(len(text)), texts.sizes)  # of each feature
    used = ~rest[text]
    if not (used & sure[text]).any() or not truth[~rest].any():
        return model
    number = np.cumsum(~rest) - 1
    chosen = used[unit]
    ids, owner = texts.ids[chosen], number[text[used]]
    sentence = np.repeat(np.arange(int(used.sum())), texts.sizes[used])
    asked = sure[~rest]
    model.places = telling(ids[asked[owner[sentence]]], (np.cumsum(asked) - 1)[owner[sentence]][asked[owner[sentence]]], truth[~rest][asked])
    place = model.places[ids]
    sentence, place = sentence[place > 0], place[place > 0]
    counts = np.bincount(sentence, minlength=len(owner))
    model.weights, _ = fit(place, owner[sentence], truth[~rest], scaled=True, spread=spread)
    at = np.arange(len(owner))
    allowed = truth[~rest][owner] > 0
    for _ in range(2):
        raw = _sums(model.weights[place], counts)
        best = np.where(allowed, raw, -np.inf).argmax(1)
        clear = allowed.any(1) & (raw[at, best] > 0) & (raw[at, best] >= raw.max(1))
        targets = np.zeros_like(raw)
        targets[at[clear], best[clear]] = 1
        model.weights, model.biases = fit(place, sentence, targets, spread=spread)
    scores = model.documents(joined([texts.part(i) for i in np.flatnonzero(rest)]))
    for c in range(len(subjects)):
        model.thresholds[c] = calibrate(scores[:, c], truth[rest][:, c] > 0)
    return model


def calibrate(scores: np.ndarray, truth: np.ndarray) -> float:
    """The threshold of the greatest F1, between two scores; 0 without positive cases."""
    order = np.argsort(-scores, kind="stable")
    s, t = scores[order], truth[order]
    if not t.any():
        return 0.0
    hits = np.cumsum(t)
    f1 = 2 * hits / (np.arange(1, len(t) + 1) + t.sum())
    f1[np.append(s[1:] == s[:-1], False)] = 0  # no threshold parts equal scores
    f1[~np.isfinite(s)] = np.where(s[~np.isfinite(s)] > 0, f1[~np.isfinite(s)], 0)
    best = int(f1.argmax())
    below = s[best + 1] if best + 1 < len(s) else -np.inf
    middle = (min(s[best], 50.0) + max(below, -6.0)) / 2
    return float(np.clip(middle, -4.0, 2.0))


def source_labels(documents: DataFrame, named: DataFrame, share: float = SOURCE_SHARE, known: int = SOURCE_KNOWN) -> DataFrame:
    """``doc_id, subjects``: labels of unlabelled documents by their source alone.

    Of a source's labelled documents, ``known`` or more, at least ``share`` must have the
    subject. Null sources label nothing. ``named`` has a row per labelled document with its
    subjects. Only ids and sources move.
    """
    placed = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("source")).alias("source")).where("source is not null")
    placed = checkpointed(placed.join(named, "doc_id", "left").select("doc_id", "source", "subjects"))
    told = placed.where("subjects is not null")
    hits = told.select("source", F.explode("subjects").alias("subject")).groupBy("source", "subject").agg(F.count("*").alias("hits"))
    rules = hits.join(told.groupBy("source").agg(F.count("*").alias("n")), "source").where((F.col("n") >= known) & (F.col("hits") >= share * F.col("n")))
    rules = rules.groupBy("source").agg(F.sort_array(F.collect_set("subject")).alias("given"))
    return placed.where("subjects is null").join(rules, "source").groupBy("doc_id").agg(F.max("given").alias("subjects"))


_FEATURES = "ids array<int>, sizes array<int>, alone array<boolean>, passages array<int>"


def labelled_sample(documents: DataFrame, labels: DataFrame, subjects: list[str], most: int = MOST_LABELLED, features: int = MOST_FEATURES) -> tuple[Parsed, list[list[str]], list[bool]]:
    """At most ``most`` documents with all labels given to them, as numbers, chosen by hash of their ids, and whether the labels are a source's.

    No text leaves its task, and at most ``features`` numbers do: whole documents in order
    of the hash, the first of which always. Where ``documents`` has a source, it labels too.
    """
    ship_package(documents.sparkSession)
    labels = labels.where(F.col("subject").isin(subjects) & F.col("doc_id").isNotNull())
    named = labels.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    told = named.withColumn("weak", F.lit(False))
    if "source" in documents.columns:
        told = told.unionByName(source_labels(documents, named).withColumn("weak", F.lit(True)))
    chosen = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(batch.column(3).to_pylist()):
                own = parsed([text])
                kinds = (pa.int32(), pa.int32(), pa.bool_(), pa.int32())
                lists = [pa.array([x.tolist()], pa.list_(k)) for x, k in zip((own.ids, own.sizes, own.alone, own.passages), kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(3)), *lists], names=["at", "subjects", "weak", "ids", "sizes", "alone", "passages"])

    texts = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    # of a repeated id one text, the same in any run
    rows = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"), F.first("subjects").alias("subjects"), F.first("weak").alias("weak"))
    rows = checkpointed(rows.select(F.xxhash64("doc_id").alias("at"), "subjects", "weak", "text").mapInArrow(run, f"at long, subjects array<string>, weak boolean, {_FEATURES}"))
    total, last = 0, None
    for r in rows.select("at", F.size("ids").alias("n")).orderBy("at").collect():  # at most ``most`` rows of two numbers
        total += r.n
        if last is not None and total > features:
            break
        last = r.at
    kept = [] if last is None else rows.where(F.col("at") <= last).orderBy("at").toArrow().to_pylist()
    parts = [Parsed(*(np.array(r[c], t) for c, t in (("ids", np.int64), ("sizes", np.int64), ("alone", bool), ("passages", np.int64))), np.array([len(r["passages"])])) for r in kept]
    return joined(parts), [r["subjects"] for r in kept], [r["weak"] for r in kept]


def spread_over(spark: SparkSession) -> Callable:
    """A map over the executors, for functions of one array that return an array and a number; one task per argument."""

    def run(f: Callable, arrays: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, float]]:
        ship_package(spark)
        arrays = [a.astype(bool) if np.isin(a, (0, 1)).all() else a for a in arrays]
        shared = spark.sparkContext.broadcast((f, arrays))
        count = len(arrays)

        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in batch.column(0).to_pylist():
                    own, arguments = shared.value
                    weights, bias = own(arguments[i].astype(float))
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([weights.tobytes()], pa.binary()), pa.array([float(bias)])], names=["i", "w", "b"])

        found = spark.range(0, count, 1, count).mapInArrow(work, "i long, w binary, b double").collect()
        shared.destroy()
        for r in sorted(found, key=lambda r: r.i):
            yield np.frombuffer(bytes(r.w)), r.b

    return run


def assign(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id, subject, score``: one row per document and subject at or above its threshold.

    Null and blank texts, and texts without two sentences on any subject, have no row.
    Repeated documents each have their rows; other columns are ignored.
    """
    ship_package(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        names = np.array(own.subjects)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in cores.blocks(texts):
                scores = own.documents(parsed(texts[lo:hi]))
                doc, subject = np.nonzero((scores >= own.thresholds) & np.isfinite(scores))
                picked = batch.column(0).slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([picked, pa.array(names[subject].tolist(), pa.string()), pa.array(np.clip(scores[doc, subject], -99, 99))], names=["doc_id", "subject", "score"])

    return spread(documents.select("doc_id", "text").where(F.col("text").isNotNull())).mapInArrow(run, f"doc_id {kind}, subject string, score double")
