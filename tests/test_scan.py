"""Two-level running values against window functions."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from meterline.operators.scan import running

VALUES = {"s": ("sum", "v"), "lo": ("min", "v"), "hi": ("max", "v"), "la": ("last", "t"), "fi": ("first", "t"), "twice": ("sum", "2 * v")}


@pytest.mark.parametrize("seed", [1, 2])
def test_running_equals_windows(spark, seed):
    rng = random.Random(seed)
    keys = [None, "a", "b"] + ["hot"] * 12
    data = [(rng.choice(keys), k, rng.choice([None, rng.randrange(-9, 9)]), rng.choice([None, None, f"t{k}"])) for k in range(900)]
    df = spark.createDataFrame(data, "k string, o long, v long, t string").repartition(5)
    w = Window.partitionBy("k").orderBy("o").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("*", F.sum("v").over(w), F.min("v").over(w), F.max("v").over(w), F.last("t", True).over(w), F.first("t", True).over(w), F.sum(2 * F.col("v")).over(w))
    got = running(df, ["k"], ["o"], **VALUES)
    assert got.columns == [*df.columns, *VALUES]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_a_hot_key_is_many_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    df = spark.range(20_000).selectExpr("IF(id % 10 < 9, 'hot', 'cold') AS k", "id AS o", "1 AS v")
    got = running(df, ["k"], ["o"], n=("sum", "v"))
    spread = got.filter("k = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got.filter("k = 'hot'").agg(F.max("n")).first()[0] == 18_000 and len(spread) > 1


def test_no_rows(spark):
    assert running(spark.createDataFrame([], "k string, o long, v long"), ["k"], ["o"], n=("sum", "v")).collect() == []
