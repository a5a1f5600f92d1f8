"""Status and states as messages arrive."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.functions.times import duration, duration_micros, elapsed, micros
from tidewire.operators.status import latest_by_feed
from tidewire.plans import scan
from tidewire.streaming.epochs import EpochTable

STATES = "member bigint, seq bigint, ts timestamp_ntz, state string, since timestamp_ntz"
TIMED = (
    "member bigint, seq bigint, ts timestamp_ntz, state string, carried boolean, opens boolean, before_state string, "
    "start timestamp_ntz, start_before timestamp_ntz"
)
CHANGES = (
    "member bigint, seq bigint, ts timestamp_ntz, state string, previous_state string, "
    "previous_start timestamp_ntz, elapsed double"
)


class StreamStates:
    """State changes of members across micro-batches.

    The last observation of each member is carried as a row and put before the new ones, so
    a micro-batch is one blocked scan, however much of it one member has."""

    def __init__(self, spark: SparkSession, root: str, block_size: int = scan.BLOCK):
        self.block_size = block_size
        self.timed = EpochTable(spark, f"{root}/timed", TIMED)
        self.states = EpochTable(spark, f"{root}/states", STATES)
        self.changes = EpochTable(spark, f"{root}/changes", CHANGES)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        carried = self.states.read(epoch - 1)
        fresh = batch.select("member", "seq", "ts", "state", F.lit(None).cast("timestamp_ntz").alias("since"))
        known = carried.join(fresh.select("member").distinct(), "member", "left_semi")
        rows = known.withColumn("carried", F.lit(True)).unionByName(fresh.withColumn("carried", F.lit(False)))
        runs = scan.islands(
            rows, ["member"], "seq", ["ts", "state"], lambda before, row: before["state"] != row["state"],
            self.block_size, previous="before", island="run",
        )
        opened = F.when(F.col("run") == F.col("seq"), F.coalesce("since", "ts"))
        timed = scan.running(
            runs.withColumn("opened", opened), ["member"], "seq",
            {"start": scan.last_known(F.col("opened")), "start_before": scan.last_known(F.col("opened"), inclusive=False)},
            self.block_size,
        )
        # Stored once; the changes and the states to carry both start from here.
        timed = self.timed.write(
            timed.select(
                "member", "seq", "ts", "state", "carried", (F.col("run") == F.col("seq")).alias("opens"),
                F.col("before")["state"].alias("before_state"), "start", "start_before",
            ),
            epoch,
        )
        # The first state of a member ends an unknown one that took no time.
        changed = timed.filter(F.col("opens") & ~F.col("carried"))
        began = F.coalesce("start_before", "ts")
        self.changes.write(
            changed.select(
                "member", "seq", "ts", "state", F.coalesce("before_state", F.lit("unknown")).alias("previous_state"),
                began.alias("previous_start"), elapsed(began, F.col("ts")).alias("elapsed"),
            ).filter(F.col("state") != F.col("previous_state")),
            epoch,
        )
        newest = timed.groupBy("member").agg(F.max_by(F.struct("seq", "ts", "state", F.col("start").alias("since")), "seq").alias("s"))
        touched = newest.select("member", "s.*")
        quiet = carried.join(touched.select("member"), "member", "left_anti")
        self.states.write(quiet.unionByName(touched), epoch)


def reduce_activity(stream: DataFrame) -> DataFrame:
    """Per feed the first and last message of each Arrow batch: what crosses the shuffle does
    not grow with a feed's traffic."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            grouped = frame.groupby("newsgroup", sort=False)["t"]
            yield grouped.agg(first="min", last="max", n="count").reset_index()

    rows = stream.select("newsgroup", micros(F.col("msg_time")).alias("t"))
    return rows.mapInPandas(run, "newsgroup string, first bigint, last bigint, n bigint")


STATUS = "newsgroup string, status string, previous_status string, changed boolean, start_us bigint, stop_us bigint, n bigint"


def stream_status(stream: DataFrame, timeout: str | float) -> DataFrame:
    """Online when a feed's message arrives, offline when none does for ``timeout`` of
    processing time; a row per change, and one for the first message of a feed."""
    wait = int(duration(timeout) * 1000)

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            status, start, stop = state.get
            state.update(("offline", start, stop))
            yield pd.DataFrame([(key[0], "offline", status, True, start, stop, 0)], columns=_STATUS_NAMES)
            return
        first, last, n = None, None, 0
        for frame in frames:
            first = int(frame["first"].min()) if first is None else min(first, int(frame["first"].min()))
            last = int(frame["last"].max()) if last is None else max(last, int(frame["last"].max()))
            n += int(frame["n"].sum())
        status, start, stop = state.get if state.exists else ("unknown", 0, 0)
        begins = status != "online"
        start = first if begins else start
        state.update(("online", start, last))
        state.setTimeoutDuration(wait)
        if begins:
            yield pd.DataFrame([(key[0], "online", status, status == "offline", start, last, n)], columns=_STATUS_NAMES)

    return (
        reduce_activity(stream)
        .groupBy("newsgroup")
        .applyInPandasWithState(
            update, STATUS, "status string, start_us bigint, stop_us bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
        )
    )


_STATUS_NAMES = ["newsgroup", "status", "previous_status", "changed", "start_us", "stop_us", "n"]


TURNS = (
    "newsgroup string, status string, previous_status string, changed boolean, change_time timestamp_ntz, "
    "start_time timestamp_ntz, stop_time timestamp_ntz, run_time double, off_time double, n bigint"
)
FEEDS = (
    "newsgroup string, status string, previous_status string, start_time timestamp_ntz, stop_time timestamp_ntz, "
    "run_time double, off_time double, n bigint, seen double"
)


class StreamStatus:
    """Status of feeds across micro-batches, in both directions, with run and off times.

    A feed with messages in a micro-batch is online; one that had none for ``timeout`` of the
    clock goes offline when a micro-batch (of any feed, or an empty one) says so. It started
    with the first message since it was offline and stopped with its last one: the run time
    is between these, the off time between its last message and the next first one, or
    the clock (seconds since 1970) while it is offline.

    ``root/feeds`` has every feed as it stands after a micro-batch, ``root/turns`` a row for
    each time a status became known or changed (``changed``). Messages are aggregated per
    feed before their shuffle; the rest is one row per feed."""

    def __init__(self, spark: SparkSession, root: str, timeout: str | float, now: Callable[[], float] = time.time):
        self.timeout, self.now = timeout, now
        self.feeds = EpochTable(spark, f"{root}/feeds", FEEDS)
        self.turns = EpochTable(spark, f"{root}/turns", TURNS)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        now = self.now()
        here = batch.groupBy("newsgroup").agg(F.min("msg_time").alias("first"), F.max("msg_time").alias("last"), F.count("*").alias("more"))
        both = self.feeds.read(epoch - 1).drop("previous_status", "run_time", "off_time").join(here, "newsgroup", "full_outer")
        came = F.col("more").isNotNull()
        silent = (F.lit(now) - F.col("seen")) * 1e6 >= duration_micros(self.timeout)
        was = F.coalesce("status", F.lit("unknown"))
        both = both.withColumns(
            {
                "previous_status": was,
                "status": F.when(came, "online").when(silent, "offline").otherwise(was),
                "start_time": F.when(came & (was != "online"), F.col("first")).otherwise(F.col("start_time")),
                # of a feed that was offline, the last message before it: what the off time counts from
                "before": F.col("stop_time"),
                "stop_time": F.when(came, F.greatest("stop_time", "last")).otherwise(F.col("stop_time")),
                "n": F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0)),
                "seen": F.when(came, F.lit(now)).otherwise(F.col("seen")),
            }
        )
        online = F.col("status") == "online"
        returned = online & (F.col("previous_status") == "offline")
        away = F.when(returned, elapsed(F.col("before"), F.col("start_time"))).when(~online, F.lit(now) - micros(F.col("stop_time")) / 1e6)
        both = both.withColumn("run_time", elapsed(F.col("start_time"), F.col("stop_time"))).withColumn("off_time", away)
        stored = self.feeds.write(both.select(*(f.split(" ")[0] for f in FEEDS.split(", "))), epoch)
        turned = stored.filter("status <> previous_status")
        online = F.col("status") == "online"
        self.turns.write(
            turned.select(
                "newsgroup", "status", "previous_status", (F.col("previous_status") != "unknown").alias("changed"),
                F.when(online, F.col("start_time")).otherwise(F.col("stop_time")).alias("change_time"), "start_time", "stop_time",
                F.when(~online, F.col("run_time")).alias("run_time"), F.when(online, F.col("off_time")).alias("off_time"), "n",
            ),
            epoch,
        )


class StreamLatest:
    """The newest message of each feed; all are forgotten when no feed had one for ``timeout``."""

    def __init__(
        self, spark: SparkSession, root: str, schema: str, timeout: str | float | None = None, now: Callable[[], float] = time.time
    ):
        self.timeout, self.now = timeout, now
        self.latest = EpochTable(spark, f"{root}/latest", f"{schema}, poll_time double")

    def apply(self, batch: DataFrame, epoch: int) -> None:
        now = self.now()
        rows = self.current(epoch - 1, now).unionByName(batch.withColumn("poll_time", F.lit(now)))
        self.latest.write(latest_by_feed(rows), epoch)

    def current(self, epoch: int, now: float | None = None) -> DataFrame:
        """The cache after a micro-batch, as a reader sees it now."""
        rows = self.latest.read(epoch)
        if self.timeout is None:
            return rows
        newest = rows.agg(F.max("poll_time")).scalar()
        seen = self.now() if now is None else now
        return rows.filter((F.lit(seen) - newest) * 1e6 <= duration_micros(self.timeout))
