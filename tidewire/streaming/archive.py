"""Archiving a feed as it arrives."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions.times import duration_micros, from_micros
from tidewire.operators.batches import BatchOptions, batch_feed, batch_table, closing_reasons
from tidewire.operators.machine import COUNT, SAVED, TIMEOUT
from tidewire.operators.payloads import FILE, INCOMPLETE, assemblies, join_parts
from tidewire.plans import scan
from tidewire.streaming.commits import ArchiveLog
from tidewire.streaming.epochs import EpochTable

MESSAGES = (
    "newsgroup string, article_number bigint, msg_time timestamp_ntz, n_bytes bigint, action string, batch_id bigint, "
    "open_id bigint, open_n bigint, open_last bigint"
)
OPEN = "newsgroup string, batch_id bigint, n bigint, last bigint, poll_time double"
TIMED_OUT = "newsgroup string, batch_id bigint, n_msgs bigint, reason string"
FIGURES = "newsgroup string, batch_id bigint, start_time timestamp_ntz, last_time timestamp_ntz, n_msgs bigint, n_bytes bigint"
REPORTS = f"{FIGURES}, reason string"


def clock() -> float:
    return time.time()


def _together(before: DataFrame, here: DataFrame) -> DataFrame:
    """Figures of batches, those of earlier micro-batches first."""
    both = before.withColumn("__order", F.lit(0)).unionByName(here.withColumn("__order", F.lit(1)))
    return both.groupBy("newsgroup", "batch_id").agg(
        F.min_by("start_time", "__order").alias("start_time"),
        F.max_by("last_time", "__order").alias("last_time"),
        F.sum("n_msgs").alias("n_msgs"),
        F.sum("n_bytes").alias("n_bytes"),
    )


class StreamArchive:
    """Batches of a feed across micro-batches, by the same rule as a whole feed at once.

    ``root/messages`` has what became of each message, ``root/open`` the open batch of each
    feed, ``root/timed_out`` the batches that closed because nothing was read from their feed
    for ``timeout``. That is looked at when a micro-batch starts, before its messages.
    ``root/reports`` has a row for each batch that closed, with its figures and the reason;
    ``root/figures`` those of the batches still open.

    With a ``log``, the files of saved messages go into it: micro-batches then have a row
    for each file (``dest, part_no, content``), and messages without files are not saved.
    A message's other columns are the same in all its rows."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        options: BatchOptions,
        timeout: str | float | None = None,
        now: Callable[[], float] = clock,
        block_size: int = scan.BLOCK,
        log: ArchiveLog | None = None,
    ):
        self.options, self.timeout, self.now, self.block_size, self.log = options, timeout, now, block_size, log
        self.figures = EpochTable(spark, f"{root}/figures", FIGURES)
        self.reports = EpochTable(spark, f"{root}/reports", REPORTS)
        self.messages = EpochTable(spark, f"{root}/messages", MESSAGES)
        self.open = EpochTable(spark, f"{root}/open", OPEN)
        self.late = EpochTable(spark, f"{root}/timed_out", TIMED_OUT)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        now = self.now()
        before = self.open.read(epoch - 1)
        carried = self.still_open(before, now)
        self.late.write(self._expired(before, now), epoch)
        messages, has_files = batch, None
        if self.log is not None:
            row = batch.groupBy("newsgroup", "article_number")
            messages = row.agg(F.first("msg_time").alias("msg_time"), F.first("n_bytes").alias("n_bytes"), F.bool_or(F.col("dest").isNotNull()).alias("__has"))
            has_files = F.col("__has")
        placed = batch_feed(messages, self.options, has_files, carried=carried, block_size=self.block_size)
        stored = self.messages.write(placed, epoch)
        last = stored.groupBy("newsgroup").agg(
            F.max_by(F.struct("open_id", "open_n", "open_last"), "article_number").alias("s")
        )
        fresh = last.select(
            "newsgroup",
            F.col("s")["open_id"].alias("batch_id"),
            F.col("s")["open_n"].alias("n"),
            F.col("s")["open_last"].alias("last"),
            F.lit(now).alias("poll_time"),
        )
        quiet = carried.join(fresh.select("newsgroup"), "newsgroup", "left_anti")
        still = self.open.write(quiet.unionByName(fresh).filter(F.col("n") > 0), epoch)
        self._report(stored, carried, still, epoch)
        if self.log is not None:
            saved = stored.filter(F.col("action") == SAVED).select("newsgroup", "article_number", "batch_id")
            files = batch.filter(F.col("dest").isNotNull()).select("newsgroup", "article_number", "part_no", "dest", "content")
            self.log.append(files.join(saved, ["newsgroup", "article_number"]), epoch)

    def _report(self, stored: DataFrame, carried: DataFrame, still: DataFrame, epoch: int) -> None:
        """Figures of all batches this micro-batch knows; of those no longer open, the report.

        An open batch of earlier micro-batches takes part as its last saved message. Where
        only the count closes batches, a full one was closed by it, whatever came later."""
        keys = ["newsgroup", "batch_id"]
        here = batch_table(stored.filter(F.col("action") == SAVED))
        known = _together(self.figures.read(epoch - 1), here)
        first = F.lit(-(1 << 62)).cast("bigint")  # before all articles
        time_saved = from_micros(F.col("last"))
        entered = carried.select("newsgroup", first.alias("article_number"), time_saved.alias("msg_time"), F.lit(SAVED).alias("action"), "batch_id")
        rows = stored.select("newsgroup", "article_number", "msg_time", "action", "batch_id").unionByName(entered)
        reasons = closing_reasons(rows, replace(self.options, max_messages=0), self.block_size)
        late = self.late.read(epoch).select(*keys, F.col("reason").alias("late"))
        closed = known.join(still.select(*keys), keys, "left_anti").join(reasons, keys, "left").join(late, keys, "left")
        limit = 0 if self.options.gap or self.options.span else self.options.max_messages
        full = F.lit(limit > 0) & (F.col("n_msgs") >= limit)
        reason = F.when(full, COUNT).otherwise(F.coalesce("late", "reason"))
        self.reports.write(closed.withColumn("reason", reason).drop("late"), epoch)
        self.figures.write(known.join(still.select(*keys), keys, "left_semi"), epoch)

    def still_open(self, state: DataFrame, now: float) -> DataFrame:
        if self.timeout is None:
            return state
        return state.filter((F.lit(now) - F.col("poll_time")) * 1e6 < duration_micros(self.timeout))

    def batches(self) -> DataFrame:
        """One row per batch so far."""
        saved = self.messages.all().filter(F.col("action") == SAVED)
        return saved.groupBy("newsgroup", "batch_id").agg(
            F.min_by("msg_time", "article_number").alias("start_time"),
            F.max_by("msg_time", "article_number").alias("last_time"),
            F.count("*").alias("n_msgs"),
            F.sum("n_bytes").alias("n_bytes"),
        )

    def _expired(self, state: DataFrame, now: float) -> DataFrame:
        late = state.join(self.still_open(state, now).select("newsgroup"), "newsgroup", "left_anti")
        return late.select("newsgroup", "batch_id", F.col("n").alias("n_msgs"), F.lit(TIMEOUT).alias("reason"))

    def timed_out(self, epoch: int) -> DataFrame:
        """All batches that timed out up to this micro-batch, and those it left open that have by
        now, with the reason."""
        stored = self.late.all().filter(F.col("epoch") <= epoch).drop("epoch")
        return stored.unionByName(self._expired(self.open.read(epoch), self.now()))


PARTS = "newsgroup string, original string, article_number bigint, part_no int, n_parts int, checksum string, content binary"
WAITING = "newsgroup string, original string, article_number bigint, part_no int, n_parts int, arrived_epoch bigint, arrived double"
PLACED = f"{WAITING}, assembly bigint, complete boolean, late boolean"
FILES = (
    "newsgroup string, filename string, article_number bigint, n_parts int, n_received bigint, checksum string, "
    "content binary, status string"
)


class StreamJoin:
    """Split files put together over several micro-batches.

    Contents are stored once, with the micro-batch they came in; what waits for more parts
    is carried as metadata only. A completed file reads its parts back from the
    micro-batches they came in."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        timeout: str | float | None = None,
        now: Callable[[], float] = clock,
        block_size: int = scan.BLOCK,
    ):
        self.timeout, self.now, self.block_size = timeout, now, block_size
        self.parts = EpochTable(spark, f"{root}/parts", PARTS)
        self.waiting = EpochTable(spark, f"{root}/waiting", WAITING)
        self.placed = EpochTable(spark, f"{root}/placed", PLACED)
        self.files = EpochTable(spark, f"{root}/files", FILES)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        now = self.now()
        if "filename" in batch.columns:  # a file that was not split is a round of one part
            batch = batch.withColumn("original", F.coalesce("original", "filename"))
        stored = self.parts.write(batch.select("newsgroup", "original", "article_number", "part_no", "n_parts", "checksum", "content"), epoch)
        arrived = stored.drop("content", "checksum").select("*", F.lit(epoch).cast("bigint").alias("arrived_epoch"), F.lit(now).alias("arrived"))
        known = self.waiting.read(epoch - 1).unionByName(arrived)
        placed = assemblies(known, self.block_size).join(
            known.select("newsgroup", "article_number", "arrived_epoch", "arrived"), ["newsgroup", "article_number"]
        )
        group = Window.partitionBy(*FILE, "assembly")
        received = F.size(F.collect_set("part_no").over(group))
        total = F.max_by("n_parts", "article_number").over(group)
        late = F.lit(False)
        if self.timeout is not None:
            late = (F.lit(now) - F.max("arrived").over(group)) * 1e6 >= duration_micros(self.timeout)
        complete = received == total
        columns = [*FILE, "article_number", "part_no", "n_parts", "arrived_epoch", "arrived"]
        # Narrow rows, stored once; everything below starts from them.
        judged = self.placed.write(
            placed.select(*columns, "assembly", complete.alias("complete"), (late & ~complete).alias("late")), epoch
        )
        self.waiting.write(judged.filter(~F.col("complete") & ~F.col("late")).select(*columns), epoch)

        ready = judged.filter("complete or late")
        wanted = ready.select("newsgroup", "article_number", F.col("arrived_epoch").alias("epoch"))
        # only micro-batches that something waits for are read: at most one number for each
        epochs = [r["epoch"] for r in wanted.select("epoch").distinct().collect()]
        contents = self.parts.some(epochs).join(wanted, ["newsgroup", "article_number", "epoch"], "left_semi").drop("epoch")
        joined = join_parts(contents, placed=ready.select(*FILE, "assembly", "article_number", "part_no", "n_parts"))
        self.files.write(
            joined.select("newsgroup", "filename", "article_number", "n_parts", "n_received", "checksum", "content", "status"),
            epoch,
        )

    def completed(self) -> DataFrame:
        return self.files.all().filter(F.col("status") != INCOMPLETE).drop("epoch")
