"""Several feeds as one while they arrive."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.times import duration, from_micros, micros
from tidewire.operators.merge import feed_index, ranked
from tidewire.plans import scan
from tidewire.streaming.epochs import EpochTable

FEEDS = "newsgroup string, feed_index bigint, peak bigint, seen_at double"
PROGRESS = "bound bigint, bound_index bigint, total bigint"
KEY = ["merge_us", "feed_index", "article_number"]


class StreamMerge:
    """The order of sync_merge, released as far as it is sure; ``rank`` counts on over micro-batches.

    A feed's frontier is its latest time so far: no message still to come sorts before it. What
    lies up to the lowest frontier is released in order, the rest waits; a feed from which
    nothing came yet holds everything. A feed silent for ``timeout`` of the clock holds
    nothing; what it sends after that is placed behind what was released without it. Without
    a timeout any arrivals give the ranks of the batch merge. Each feed must arrive by article
    number; messages without a time take the latest one before them, leading ones come first.

    ``schema`` describes the rows: ``newsgroup, article_number, msg_time`` and what else they have.
    A micro-batch reads and writes what waits and what came, not what was released."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        feeds: Sequence[str],
        timeout: str | float | None = None,
        now: Callable[[], float] = time.time,
        block_size: int = scan.BLOCK,
    ):
        self.spark, self.names, self.block_size, self.now = spark, list(feeds), block_size, now
        self.timeout = None if timeout is None else duration(timeout)
        self.pool = EpochTable(spark, f"{root}/pool", f"{schema}, merge_us bigint, feed_index bigint, came bigint")
        self.feeds = EpochTable(spark, f"{root}/feeds", FEEDS)
        self.progress = EpochTable(spark, f"{root}/progress", PROGRESS)
        self.merged = EpochTable(spark, f"{root}/merged", f"{schema}, feed_index bigint, merge_time timestamp_ntz, rank bigint")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        now = self.now()
        # a row for each configured feed at most
        known = {r.newsgroup: r for r in self.feeds.read(epoch - 1).collect()}
        past = self.progress.read(epoch - 1).first()
        floor = past.bound if past else None
        # what new messages can't fall behind: their feed's peak, and what was released
        least = [(name, _latest(known[name].peak if name in known else None, floor)) for name in self.names]

        chosen = batch.filter(F.col("newsgroup").isin(self.names)).withColumn("__t", micros(F.col("msg_time")))
        peaks = scan.running(chosen, ["newsgroup"], "article_number", {"__peak": scan.running_max(F.col("__t"))}, self.block_size)
        fresh = peaks.join(self.spark.createDataFrame(least, "newsgroup string, __least bigint"), "newsgroup")
        fresh = fresh.withColumn("merge_us", F.greatest("__peak", "__least")).withColumn("feed_index", feed_index(self.names))
        waiting = self._waiting(epoch - 1)
        pool = self.pool.write(waiting.unionByName(fresh.withColumn("came", F.lit(epoch)).select(waiting.columns)), epoch)

        heard = {r.newsgroup: r.peak for r in pool.filter(F.col("came") == epoch).groupBy("newsgroup").agg(F.max("merge_us").alias("peak")).collect()}
        state = []
        for i, name in enumerate(self.names):
            old = known.get(name)
            peak = _latest(old.peak if old else None, heard.get(name))
            state.append((name, i, peak, now if name in heard or old is None else old.seen_at))
        bound, index = self._frontier(state, now)
        total = past.total if past else 0
        out = self.merged.write(self._ranked(pool.filter(_sure(bound, index)), total), epoch)
        self.feeds.write(self.spark.createDataFrame(state, FEEDS), epoch)
        self.progress.write(self.spark.createDataFrame([(bound, index, total + out.count())], PROGRESS), epoch)

    def _frontier(self, state: list[tuple], now: float) -> tuple:
        """The lowest place at which a message may still come; nothing where that can be any."""
        active = [(peak, i) for _, i, peak, seen in state if self.timeout is None or now - seen < self.timeout]
        if not active:
            return max(((peak, len(state)) for _, _, peak, _ in state if peak is not None), default=(None, None))
        return (None, None) if any(peak is None for peak, _ in active) else min(active)

    def _waiting(self, epoch: int) -> DataFrame:
        past = self.progress.read(epoch).first()
        return self.pool.read(epoch).filter(~_sure(past.bound, past.bound_index) if past else F.lit(True))

    def _ranked(self, rows: DataFrame, after: int) -> DataFrame:
        placed = ranked(rows.orderBy(*KEY), after)
        return placed.withColumn("merge_time", from_micros(F.col("merge_us"))).drop("merge_us", "came")

    def rest(self, epoch: int) -> DataFrame:
        """What still waits after a micro-batch, in its order, as if every feed had ended."""
        return self._ranked(self._waiting(epoch), self.progress.read(epoch).first().total)


def _latest(*times: int | None) -> int | None:
    return max((t for t in times if t is not None), default=None)


def _sure(bound: int | None, index: int | None) -> Column:
    """Whether a row can't be preceded by one still to come."""
    if bound is None:
        return F.lit(False)
    here = (F.col("merge_us") == bound) & (F.col("feed_index") <= index)
    return F.coalesce((F.col("merge_us") < bound) | here, F.lit(True))
