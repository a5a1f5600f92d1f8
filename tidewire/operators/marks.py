"""Incremental reading: last-read marks per reader and feed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.operators.select import feed_marks
from tidewire.plans.storage import stage


def effective_marks(feeds: DataFrame, marks: DataFrame) -> DataFrame:
    """The mark reading really starts from: just below the low mark where there is no mark,
    or where the mark lies outside what the server has (it was renumbered)."""
    start = F.col("low") - 1
    valid = (F.col("last_read") >= start) & (F.col("last_read") <= F.col("high"))
    known = marks.select("newsgroup", "last_read")
    return feeds.join(known, "newsgroup", "left").withColumn(
        "mark", F.when(F.coalesce(valid, F.lit(False)), F.col("last_read")).otherwise(start)
    )


def unread(messages: DataFrame, marks: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Messages past the last-read mark; the marks have one row per feed.

    The lowest mark, one number, is a plain comparison that reaches the scan, so that a poll
    reads what is new. ``feeds`` (``newsgroup, low, high``), where the caller keeps such a
    table, spares the pass over all article numbers. Starts a job when called."""
    known = feed_marks(messages) if feeds is None else feeds
    starts = stage(effective_marks(known, marks).select("newsgroup", "mark"), "marks")
    oldest = starts.agg(F.min("mark")).first()[0]
    new = messages if oldest is None else messages.filter(F.col("article_number") > oldest)
    return new.join(starts, ["newsgroup"]).filter(F.col("article_number") > F.col("mark")).drop("mark")


def catch_up(feeds: DataFrame, marks: DataFrame, n: int, reset: bool = False) -> DataFrame:
    """New marks: 0 keeps them, 1 skips everything, -k leaves the newest k unread
    (never moving back unless ``reset``)."""
    if n > 1:
        raise ValueError("catch_up takes 0, 1 or a negative number")
    known = feeds.join(marks.select("newsgroup", "last_read"), "newsgroup", "left")
    current = F.coalesce("last_read", F.col("low") - 1)
    if n == 0:
        new: Column = current
    elif n == 1:
        new = F.col("high")
    elif reset:
        new = F.greatest(F.lit(0), F.col("high") + n)
    else:
        new = F.greatest(current, F.col("high") + n)
    return known.select("newsgroup", new.cast("bigint").alias("last_read"))


def last_n(messages: DataFrame, n: int) -> DataFrame:
    """The newest n messages of each feed; Spark cuts each partition to n before the shuffle."""
    w = Window.partitionBy("newsgroup").orderBy(F.desc("article_number"))
    return messages.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def next_unread(messages: DataFrame, marks: DataFrame, feeds: DataFrame | None = None) -> DataFrame:
    """Only the next unread message of each feed."""
    w = Window.partitionBy("newsgroup").orderBy("article_number")
    rows = unread(messages, marks, feeds)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= 1).drop("__r")


def advance_marks(processed: DataFrame, marks: DataFrame) -> DataFrame:
    """Move each (reader, feed) mark to the last processed article; ``processed`` has
    ``reader, newsgroup, article_number``. Marks never move back here."""
    done = processed.groupBy("reader", "newsgroup").agg(F.max("article_number").alias("__done"))
    return marks.join(done, ["reader", "newsgroup"], "full_outer").select(
        "reader", "newsgroup", F.greatest("last_read", "__done").alias("last_read")
    )
