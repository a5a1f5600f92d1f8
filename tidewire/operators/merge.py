"""Merging feeds and logs in time order, and ranking feeds.

A merge position over all rows would need one task, so the merges give a sort
key; ``orderBy`` on it is a range-partitioned sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.times import from_micros, micros
from tidewire.plans import scan
from tidewire.plans.storage import stage

MERGE_ORDER = ["merge_time", "feed_index", "article_number"]


def feed_index(feeds: Sequence[str]) -> Column:
    """Position of a feed in the configured list."""
    return F.array_position(F.array(*[F.lit(f) for f in feeds]), F.col("newsgroup")).cast("bigint") - 1


def sync_merge(messages: DataFrame, feeds: Sequence[str], block_size: int = scan.BLOCK) -> DataFrame:
    """Several feeds as one: always the feed whose next message is oldest, ties to the first
    configured, the order inside a feed kept.

    That order is the sort order of (latest time so far in the feed, feed, article): a
    message behind a later one waits for it."""
    chosen = messages.filter(F.col("newsgroup").isin(list(feeds))).withColumn("__t", micros(F.col("msg_time")))
    peaks = scan.running(chosen, ["newsgroup"], "article_number", {"__peak": scan.running_max(F.col("__t"))}, block_size)
    keyed = peaks.withColumn("merge_time", from_micros(F.col("__peak"))).withColumn("feed_index", feed_index(feeds))
    return keyed.drop("__t", "__peak").orderBy(*MERGE_ORDER)


def ranked(ordered: DataFrame, after: int = 0) -> DataFrame:
    """Sorted rows with their place in the order, counted on from ``after``, as ``rank``. The
    rows are stored as they were sorted; only counts per task are summed up."""
    rows = stage(ordered.withColumn("__id", F.monotonically_increasing_id()), "ranked").withColumn("__part", F.shiftright("__id", 33))
    sizes = rows.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    place = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1)) + 1 + after
    return rows.join(starts, "__part").withColumn("rank", place).drop("__part", "__id", "__before")


def log_order(records: DataFrame) -> list[str]:
    """Time, then, where records have them, file and place in it: ties keep their order."""
    return ["asctime", *(c for c in ("path", "record_no") if c in records.columns)]


def merge_logs(records: DataFrame) -> DataFrame:
    """All records by time, and at one time by file and place."""
    return records.orderBy(*log_order(records))


def tail_logs(records: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """The n newest records, oldest first."""
    order = log_order(records) if order is None else order
    newest = records.orderBy(*[F.desc(c) for c in order]).limit(n)
    return newest.orderBy(*order)


def rank_feeds(feeds: DataFrame, by: str = "name", reverse: bool = False) -> DataFrame:
    """Feeds sorted by name or count (ties by name)."""
    keys = ["newsgroup"] if by == "name" else ["n_articles", "newsgroup"]
    return feeds.orderBy(*[F.desc(k) if reverse else F.asc(k) for k in keys])
