"""Blocked scans equal plain windows, wherever the block borders fall."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewire.plans import scan


def rows(seed):
    rng = random.Random(seed)
    out = []
    for key in "abc":
        for n in sorted(rng.sample(range(1, 120), rng.randint(1, 60))):
            out.append((key, n, rng.choice([None, rng.randint(-5, 5)]), rng.choice("xyz")))
    return out


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_running_equals_window(spark, block):
    df = spark.createDataFrame(rows(block), "k string, n bigint, v bigint, s string")
    got = scan.running(
        df, ["k"], "n",
        {
            "total": scan.running_sum(F.col("v")), "count": scan.running_count(), "peak": scan.running_max(F.col("v")),
            "low": scan.running_min(F.col("v"), inclusive=False), "known": scan.last_known(F.col("v")),
            "before": scan.previous("v", "s"),
        },
        block,
    )
    w = Window.partitionBy("k").orderBy("n")
    upto, ahead = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    expected = df.select(
        "*", F.coalesce(F.sum("v").over(upto), F.lit(0)).alias("total"), F.count("*").over(upto).alias("count"),
        F.max("v").over(upto).alias("peak"), F.min("v").over(ahead).alias("low"),
        F.last("v", ignorenulls=True).over(upto).alias("known"), F.lag(F.struct("v", "s")).over(w).alias("before"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(got.columns).collect()))


@pytest.mark.parametrize("block", [1, 9, 1000])
def test_islands_equal_window(spark, block):
    df = spark.createDataFrame(rows(10 + block), "k string, n bigint, v bigint, s string")
    got = scan.islands(
        df, ["k"], "n", ["s"], lambda before, row: before["s"] != row["s"], block, "before", "run", following="after"
    )
    w = Window.partitionBy("k").orderBy("n")
    flag = F.lag("s").over(w).isNull() | (F.lag("s").over(w) != F.col("s"))
    expected = df.withColumn("f", F.when(flag, F.col("n"))).select(
        "k", "n", "v", "s", F.when(F.lag("s").over(w).isNotNull(), F.struct(F.lag("s").over(w).alias("s"))).alias("before"),
        F.last("f", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        F.when(F.lead("s").over(w).isNotNull(), F.struct(F.lead("s").over(w).alias("s"))).alias("after"),
    )
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_rows_are_shuffled_once(spark):
    """One exchange on (key, block) for the rows; the summary adds only narrow ones."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("n"))
    out = scan.running(df, ["k"], "n", {"c": scan.running_count()}, 64)
    text = out._jdf.queryExecution().executedPlan().toString()
    assert text.count("hashpartitioning(k") <= 4
    assert "SinglePartition" not in text
