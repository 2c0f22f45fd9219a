"""De-duplication, set operations by id, length bins, quotas and splits.

Order is by md5 of id and seed wherever the result should look random: the same on every
engine, and independent of how rows are laid out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .skew import spread_rank


def first_wins(df: DataFrame, key: str, *order: Column) -> DataFrame:
    """The first row of each key in the given order; rows with a null or blank key are dropped."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = df.where(F.col(key).isNotNull() & (F.trim(F.col(key).cast("string")) != ""))
    return kept.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def without(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't in the other table."""
    return df.join(other.select(key).distinct(), key, "left_anti")


def within(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    """Rows whose key is in the other table."""
    return df.join(other.select(key).distinct(), key, "left_semi")


def union_first(key: str, *parts: DataFrame) -> DataFrame:
    """All rows of the parts by name; of one key, the row of the earliest part."""
    whole = None
    for i, part in enumerate(parts):
        part = part.withColumn("_part", F.lit(i))
        whole = part if whole is None else whole.unionByName(part, allowMissingColumns=True)
    return first_wins(whole, key, F.col("_part")).drop("_part")


def shuffled(key: Column, seed: int) -> Column:
    """A stand-in for a random order."""
    return F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))


def length_thresholds(df: DataFrame, length: str) -> DataFrame:
    """One row q1, q2, q3: the lengths at the floor ranks of the quarters.

    Found from counts per length, which are few, not by sorting rows.
    """
    counts = df.groupBy(F.col(length).alias("_length")).agg(F.count("*").alias("_n"))
    w = Window.orderBy("_length").rowsBetween(Window.unboundedPreceding, 0)
    ranked = counts.withColumn("upto", F.sum("_n").over(w)).withColumn("total", F.sum("_n").over(Window.partitionBy(F.lit(1))))
    at = [F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q), F.col("_length"))).alias(f"q{i + 1}") for i, q in enumerate((0.25, 0.5, 0.75))]
    return ranked.agg(*at)


def length_bins(df: DataFrame, length: str) -> DataFrame:
    """Adds bin 0 to 3: the first quarter's threshold that the length doesn't exceed."""
    cut = F.broadcast(length_thresholds(df, length))  # one row
    bins = F.when(F.col(length) <= F.col("q1"), 0).when(F.col(length) <= F.col("q2"), 1).when(F.col(length) <= F.col("q3"), 2).otherwise(3)
    return df.crossJoin(cut).withColumn("bin", bins).drop("q1", "q2", "q3")


def quotas(strata: DataFrame, target: int) -> DataFrame:
    """Adds quota to strata (key, cap): shares of the target in whole numbers by largest remainder.

    A target of 0 or less gives 0, one beyond the total gives every cap.
    """
    total = F.sum("cap").over(Window.partitionBy(F.lit(1)))
    exact = F.col("cap") / F.col("total") * F.lit(float(target))
    df = strata.withColumn("total", total).withColumn("exact", exact).withColumn("base", F.floor("exact")).withColumn("part", F.col("exact") - F.col("base"))
    left = F.lit(target) - F.sum("base").over(Window.partitionBy(F.lit(1)))
    df = df.withColumn("left", left).withColumn("rank", F.row_number().over(Window.orderBy(F.col("part").desc(), F.col("key"))))
    quota = F.least(F.col("cap"), F.col("base") + F.when(F.col("rank") <= F.col("left"), 1).otherwise(0))
    return df.withColumn("quota", F.when(F.lit(target <= 0), 0).when(F.col("total") <= target, F.col("cap")).otherwise(quota).cast("long")).select("key", "cap", "quota")


def stratified(df: DataFrame, key: Column, id_col: str, target: int, seed: int = 42) -> DataFrame:
    """About ``target`` rows: each stratum's quota in shuffled order, then leftovers until the target."""
    keyed = df.withColumn("_key", key).withColumn("_order", shuffled(F.col(id_col), seed))
    plan = quotas(keyed.groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("cap")), target)
    ranked = spread_rank(keyed, "_key", [F.col("_order"), F.col(id_col)], "_rn")
    marked = ranked.join(F.broadcast(plan), F.col("_key") == F.col("key")).withColumn("_in", F.col("_rn") <= F.col("quota"))
    top = marked.orderBy(F.col("_in").desc(), "_order", id_col).limit(max(0, target))
    return top.drop("_key", "_order", "_rn", "_in", "key", "cap", "quota")


def _numbered(df: DataFrame, key: str, id_col: str, seed: int) -> DataFrame:
    """Adds _rn, the place in shuffled order within the key, and _n, the key's rows; a hot key is numbered in ranges."""
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    ranked = spread_rank(df.withColumn("_order", shuffled(F.col(id_col), seed)), key, [F.col("_order"), F.col(id_col)], "_rn").drop("_order")
    own = sizes.withColumnRenamed(key, "_key")
    # a row per key; null is a key of its own
    return ranked.join(own, ranked[key].eqNullSafe(own["_key"])).drop("_key")


def two_way(df: DataFrame, key: str, id_col: str, ratio: float, seed: int = 42) -> DataFrame:
    """Adds split: per key, round(n * ratio) rows but at least 1 and at most n - 1 are valid; a lone row is train."""
    valid = F.greatest(F.lit(1), F.least(F.bround(F.col("_n") * F.lit(ratio)), F.col("_n") - 1))
    return _numbered(df, key, id_col, seed).withColumn("split", F.when((F.col("_n") > 1) & (F.col("_rn") <= valid), "valid").otherwise("train")).drop("_n", "_rn")


def three_way(df: DataFrame, key: str, id_col: str, seed: int = 42, train: float = 0.8, valid: float = 0.1) -> DataFrame:
    """Adds split train, valid or test per key; one row is test, two are train and test."""
    n = F.col("_n")
    many = F.greatest(F.lit(1), F.least(F.bround(n * F.lit(train)), n - 2))
    a = F.when(n == 1, 0).when(n == 2, 1).otherwise(many)
    b = F.when(n <= 2, 0).otherwise(F.greatest(F.lit(1), F.least(F.bround(n * F.lit(valid)), n - a - 1)))
    return _numbered(df, key, id_col, seed).withColumn("split", F.when(F.col("_rn") <= a, "train").when(F.col("_rn") <= a + b, "valid").otherwise("test")).drop("_n", "_rn")


def ranks(df: DataFrame, by: str, number: str, width: int = 100_000) -> DataFrame:
    """Adds rank, from 1, in the order of a whole-number column within each group.

    Rows are numbered within stretches of ``width`` numbers, and the stretches, which are
    few, by a running sum of their counts, so that a hot group isn't one task. Ties have
    no defined order; rows with a null number have no rank.
    """
    cut = df.where(F.col(number).isNotNull()).withColumn("_stretch", F.floor(F.col(number) / F.lit(width)))
    counts = cut.groupBy(by, "_stretch").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(by, "_stretch", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(by, "_stretch").orderBy(number))
    return cut.withColumn("_own", own).join(before, [by, "_stretch"]).withColumn("rank", F.col("_own") + F.col("_before")).drop("_stretch", "_own", "_before")


def slice_rows(df: DataFrame, order: list[Column], start: int, end: int) -> DataFrame:
    """Rows number start to end - 1 in the given order, numbered in ranges; an end before the start is an error."""
    if end < start:
        raise ValueError("end is before start")
    return spread_rank(df, None, order, "_rn").where((F.col("_rn") > start) & (F.col("_rn") <= end)).drop("_rn")


def replicated(df: DataFrame, id_col: str, order: list[Column], n: int, split: str) -> DataFrame:
    """``n`` rows that go round the table in order, with ids ``{id}_{split}_{i}``; the table should be small."""
    base = df.withColumn("_rn", F.row_number().over(Window.orderBy(*order)) - 1).withColumn("_n", F.count("*").over(Window.partitionBy(F.lit(1))))
    times = F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.lit(n) - 1 - F.col("_rn")) / F.col("_n"))))
    rows = base.where(F.col("_rn") < n).withColumn("_k", F.explode(times)).withColumn("_i", F.col("_rn") + F.col("_k") * F.col("_n"))
    return rows.withColumn(id_col, F.format_string(f"%s_{split}_%d", F.col(id_col), F.col("_i"))).drop("_rn", "_n", "_k", "_i")


def per_source_limit(df: DataFrame, source: str, order: list[Column], most: int) -> DataFrame:
    """At most ``most`` rows of each source; 0 keeps all."""
    if most <= 0:
        return df
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_rn") <= most).drop("_rn")


def annotated(df: DataFrame, sizes: dict[str, int], order: list[Column], columns: dict[str, Column] | None = None, part: str = "part") -> DataFrame:
    """Consecutive samples of the table in the given order, each named in ``part``, with further columns, combined again.

    ``sizes`` gives each sample's rows; the table may end before them. Rows beyond have none.
    """
    ranked, start, name = spread_rank(df, None, order, "_rn"), 0, F.lit(None).cast("string")
    for label, size in sizes.items():
        name = F.when(F.col("_rn").between(start + 1, start + size), label).otherwise(name)
        start += max(0, size)
    return ranked.where(F.col("_rn") <= start).withColumns({part: name, **(columns or {})}).drop("_rn")
