"""Joining a big table with a summary of unknown but usually small size."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.functions.times import micros
from tidewire.plans.storage import stage


def join_measured(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Write the summary to the shared folder first, then join.

    Spark then knows its real size before it plans the join: below
    spark.sql.autoBroadcastJoinThreshold the big side is not shuffled at all,
    above it the join is a sort-merge join whose skew AQE splits."""
    return big.join(stage(small, "summary"), list(on), how)


def newest_of(rows: DataFrame, keys: Sequence[str], time: str, age_micros: int, comparison: str) -> DataFrame:
    """Rows whose age, counted back from the newest time of their key, stands in the comparison
    (``<=`` or ``<``) to ``age_micros``.

    The newest times are written first; the oldest time that any key still wants is then a
    plain comparison that reaches the scan. Starts a job when called."""
    newest = stage(rows.groupBy(*keys).agg(F.max(time).alias("__newest")), "newest")
    oldest = newest.agg(F.min("__newest")).first()[0]
    if oldest is not None:
        start = oldest - datetime.timedelta(microseconds=age_micros)
        rows = rows.filter(F.col(time) >= F.lit(start.isoformat(sep=" ")).cast(rows.schema[time].dataType))
    age = micros(F.col("__newest")) - micros(F.col(time))
    kept = rows.join(newest, list(keys))
    return kept.filter(age <= age_micros if comparison == "<=" else age < age_micros).drop("__newest")
