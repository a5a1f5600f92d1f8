"""Rosters: who is missing, what changed, what was cancelled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def missing_members(expected: DataFrame, running: DataFrame, on: Sequence[str]) -> DataFrame:
    """Expected members that are not running."""
    return expected.join(running.select(*on).distinct(), list(on), "left_anti")


def roster_diff(old: DataFrame, new: DataFrame, on: Sequence[str]) -> DataFrame:
    """Names of both rosters as stale, new or existing."""
    before = old.select(*on).distinct().withColumn("__old", F.lit(True))
    after = new.select(*on).distinct().withColumn("__new", F.lit(True))
    status = F.when(F.col("__new").isNull(), "stale").when(F.col("__old").isNull(), "new").otherwise("existing")
    return before.join(after, list(on), "full_outer").withColumn("status", status).drop("__old", "__new")


def cancel(messages: DataFrame, targets: DataFrame) -> DataFrame:
    """Messages without those whose id was cancelled."""
    return messages.join(targets.select("message_id").distinct(), "message_id", "left_anti")


def cancel_feed(messages: DataFrame, newsgroup: str) -> DataFrame:
    """Ids that cancel everything in a feed."""
    return messages.filter(F.col("newsgroup") == newsgroup).select("message_id")
