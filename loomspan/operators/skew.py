"""Joins that no single key can pull into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpointed

#: A key is hot if it holds more than this share of the rows: at most a thousand keys can.
SHARE = 1 / 1000
#: Into so many parts a hot key's rows are split.
SALTS = 64


def hot_values(df: DataFrame, key: str, share: float = SHARE, least: int = 10_000, total: int | None = None) -> list:
    """Values of ``key`` that hold more than ``share`` of the rows, and over ``least`` of them.

    By definition fewer than ``1 / share`` values, whatever the input; counts are summed
    before they are shuffled. ``total`` may be the number of rows, where it is known, and
    saves a pass. Nulls are never hot: they join nothing.
    """
    if total is not None and total <= least:
        return []
    counted = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    total = (counted.agg(F.sum("_n")).first()[0] or 0) if total is None else total
    if total <= least:
        return []
    return [r[0] for r in counted.where(F.col("_n") > max(share * total, least)).select(key).collect()]


def spread_join(left: DataFrame, right: DataFrame, key: str, hot: list, how: str = "inner", salts: int = SALTS) -> DataFrame:
    """An equi-join by one column whose ``hot`` values are split over ``salts`` tasks each.

    A hot row of the left side goes to one part by a hash of its columns, so a repeated
    task sends it to the same one; the right side's hot rows are copied to every part.
    ``how`` may be inner, left, leftsemi or leftanti.
    """
    if not hot:
        return left.join(right, key, how)
    burning = F.coalesce(F.col(key).isin(hot), F.lit(False))
    plain = [c for c, t in left.dtypes if not t.startswith("map")]
    l = left.withColumn("_part", F.when(burning, F.pmod(F.xxhash64(*plain), F.lit(salts))).otherwise(F.lit(0)).cast("int"))
    r = right.withColumn("_part", F.explode(F.when(burning, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return l.join(r, [key, "_part"], how).drop("_part")


def spread_rank(df: DataFrame, by: str | None, order: list[Column], name: str, least: int = 100_000) -> DataFrame:
    """Adds the row's number, from 1, in order within its value of ``by`` (of the whole table if None).

    Values with a large share of the rows, or the whole table, are cut into ranges of the
    order, numbered within each and moved by how many rows lie before: no task numbers
    more than a range. Others are numbered by a window. Equal rows have no defined order.
    """
    if by is not None:
        w = Window.partitionBy(by).orderBy(*order)
        hot = hot_values(df, by, least=least)
        if not hot:
            return df.withColumn(name, F.row_number().over(w))
        burning = F.coalesce(F.col(by).isin(hot), F.lit(False))
        return df.where(~burning).withColumn(name, F.row_number().over(w)).unionByName(_ranged(df.where(burning), [by], order, name))
    return _ranged(df, [], order, name)


def _ranged(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    # the ranges are cut once: a second cut could fall elsewhere
    cut = checkpointed(df.repartitionByRange(*(F.col(b) for b in by), *order).withColumn("_part", F.spark_partition_id()))
    counts = cut.groupBy(*by, "_part").agg(F.count("*").alias("_n"))  # a row per range, or two
    w = Window.partitionBy(*by or [F.lit(1)]).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*by, "_part", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order))
    joined = cut.withColumn("_own", own).join(F.broadcast(before), [*by, "_part"])
    return joined.withColumn(name, (F.col("_own") + F.col("_before")).cast("int")).select(*df.columns, name)
