"""Disk alarms, disk reports and rates of cumulative counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.sizes import fixed, size_desc
from tidewire.functions.times import micros
from tidewire.plans import scan

# Fixed value: where a 32-bit counter starts over.
ROLLOVER = 2**32


def disk_alarms(usage: DataFrame, max_percent: float = 95.0, order: str = "seq", block_size: int = scan.BLOCK) -> DataFrame:
    """Alarm state of each mount reading (``mount, usedpct``) against the reading before it."""
    rows = usage.withColumn("alarm", F.col("usedpct") >= F.lit(max_percent))
    linked = scan.running(rows, ["mount"], order, {"__before": scan.previous("alarm")}, block_size)
    was = F.coalesce(F.col("__before")["alarm"], F.lit(False))
    now = F.col("alarm")
    notes = (
        F.when(now & ~was, "Alarm set")
        .when(was & ~now, "Cleared alarm")
        .when(now, "Low space alarm")
        .otherwise("")
    )
    return linked.withColumn("changed", now != was).withColumn("notes", notes).drop("__before")


def disk_report(alarms: DataFrame, snapshot: str = "snapshot") -> DataFrame:
    """Table of all mounts of every snapshot in which some mount's alarm changed."""
    reported = alarms.filter("changed").select(snapshot).distinct()
    return alarms.join(reported, snapshot, "left_semi").select(
        snapshot,
        "mount",
        size_desc(F.col("totalbytes")).alias("total"),
        size_desc(F.col("usedbytes")).alias("used_desc"),
        size_desc(F.col("freebytes")).alias("avail"),
        F.concat(fixed(F.col("usedpct"), 1), F.lit("%")).alias("pct_full"),
        "notes",
    )


def disk_usage(blocks: DataFrame) -> DataFrame:
    """Sizes from block counts (``blocks, available, free, block_size``): blocks reserved for
    the system count neither as total nor as used."""
    free = F.col("available") * F.col("block_size")
    reserved = F.col("free") * F.col("block_size") - free
    sized = blocks.withColumn("totalbytes", F.col("blocks") * F.col("block_size") - reserved).withColumn("freebytes", free)
    sized = sized.withColumn("usedbytes", F.col("totalbytes") - F.col("freebytes"))
    return sized.withColumn("usedpct", F.col("usedbytes") / F.col("totalbytes").cast("double") * 100)


def counter_rates(
    samples: DataFrame, keys: Sequence[str], counter: str, ts: str = "ts", order: str = "seq", block_size: int = scan.BLOCK
) -> DataFrame:
    """Rate per second of a cumulative 32-bit counter over whole elapsed seconds: 0 for the
    first sample, null where no second has passed; a falling counter has rolled over."""
    linked = scan.running(samples, keys, order, {"__before": scan.previous(counter, ts)}, block_size)
    before = F.col("__before")
    rise = F.col(counter) - before[counter]
    delta = F.when(rise < 0, rise + F.lit(ROLLOVER)).otherwise(rise)
    spent = F.floor((micros(F.col(ts)) - micros(before[ts])) / F.lit(1e6))
    rate = F.when(before.isNull(), 0.0).when(spent != 0, delta.cast("double") / spent.cast("double"))
    return linked.withColumn("rate", rate).drop("__before")
