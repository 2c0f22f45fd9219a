from pyspark.sql import Window
from pyspark.sql import functions as F

from loomspan.operators.skew import hot_values, spread_join, spread_rank
from loomspan.session import spread


def test_a_hot_key_is_named_and_split_without_changing_the_join(spark):
    left = spark.range(30_000).select(F.when(F.col("id") % 3 > 0, F.col("id")).otherwise(-1).alias("k"), F.col("id").alias("x"))
    right = spark.range(-1, 30_000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("y"))
    hot = hot_values(left, "k", least=1000)
    assert hot == [-1]
    for how in ("inner", "left", "leftsemi", "leftanti"):
        plain, spread = left.join(right, "k", how), spread_join(left, right, "k", hot, how)
        assert spread.columns == plain.columns
        assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0
    part = F.spark_partition_id()
    tasks = spread_join(left, right, "k", hot).where("k = -1").groupBy(part).count().count()
    assert tasks > 1


def test_empty_and_null_keys(spark):
    none = spark.createDataFrame([], "k string, x int")
    assert hot_values(none, "k") == []
    nulls = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    assert hot_values(nulls, "k", least=0, share=0.1) == ["a"]
    right = spark.createDataFrame([(None, 3), ("a", 4)], "k string, y int")
    assert [tuple(r) for r in spread_join(nulls, right, "k", ["a"]).collect()] == [("a", 2, 4)]
    assert sorted(map(tuple, spread_join(nulls, right, "k", ["a"], "left").collect()), key=repr) == [("a", 2, 4), (None, 1, None)]


def test_ranks_of_hot_groups_equal_one_window(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).when(F.col("id") % 7 > 0, F.lit("b")).alias("g"), F.md5(F.col("id").cast("string")).alias("h"), "id").repartition(3)
    for by in ("g", None):
        w = Window.partitionBy(by or F.lit(1)).orderBy("h")
        want = {(r.id, r.n) for r in df.withColumn("n", F.row_number().over(w)).collect()}
        assert {(r.id, r.n) for r in spread_rank(df, by, [F.col("h")], "n", least=1000).collect()} == want
    desc = {(r.id, r.n) for r in spread_rank(df, "g", [F.col("h").desc()], "n", least=1000).collect()}
    assert desc == {(r.id, r.n) for r in df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(F.col("h").desc()))).collect()}
    assert spread_rank(df.limit(0), "g", [F.col("h")], "n").count() == spread_rank(df.limit(0), None, [F.col("h")], "n").count() == 0


def test_only_scans_of_few_parts_are_spread(spark):
    cores = spark.sparkContext.defaultParallelism
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=cores)
    assert spread(few).rdd.getNumPartitions() == cores and spread(few).count() == 100
    assert spread(many) is many


def test_hot_binary_keys(spark):
    left = spark.range(300).select(F.unhex(F.when(F.col("id") % 3 > 0, F.lit("00ff")).otherwise(F.hex(F.col("id") + 65536))).alias("k"), "id")
    right = left.select("k").distinct().withColumn("y", F.lit(1))
    hot = hot_values(left, "k", share=0.1, least=10)
    assert [bytes(h) for h in hot] == [b"\x00\xff"]
    for how in ("inner", "left"):
        assert spread_join(left, right, "k", hot, how).count() == 300
