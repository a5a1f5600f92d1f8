"""Polled activity, online/offline status, state histories and their notices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.times import duration_micros, elapsed, from_micros, micros, strftime
from tidewire.plans import scan
from tidewire.plans.joins import join_measured

# The texts, labels and time format of notices and boards below are output.
NOTICE_TIME = "%a, %d %b %Y %H:%M:%S UTC"


# --------------------------------------------------------------- activity


def tick_grid(feeds: DataFrame, start: str, stop: str, period: str | float, offset: str | float = 0) -> DataFrame:
    """Every poll tick (aligned to period + offset) from start to stop for each feed."""
    step, shift = duration_micros(period), duration_micros(offset)
    low = micros(F.lit(start).cast("timestamp_ntz"))
    high = micros(F.lit(stop).cast("timestamp_ntz"))
    first = F.ceil((low - shift) / F.lit(step)).cast("bigint") * step + shift
    return feeds.select("newsgroup", F.explode(F.sequence(first, high, F.lit(step))).alias("__tick")).select(
        "newsgroup", from_micros(F.col("__tick")).alias("tick")
    )


def poll_activity(
    messages: DataFrame,
    feeds: DataFrame,
    start: str,
    stop: str,
    period: str | float,
    timeout: str | float,
    offset: str | float = 0,
) -> DataFrame:
    """Per feed and poll tick: messages of the preceding ``timeout``, first and last message time.

    No range join: a message belongs to a run of ticks it can name itself.
    Messages naming the same run are aggregated before the runs are expanded."""
    step, shift, back = duration_micros(period), duration_micros(offset), duration_micros(timeout)
    us = micros(F.col("msg_time")) - F.lit(shift)
    # no tick looks further back than the timeout: plain comparisons, which reach the scan
    oldest = F.lit(start).cast("timestamp_ntz") - F.expr(f"INTERVAL {back} MICROSECOND")
    seen = messages.filter((F.col("msg_time") >= oldest) & (F.col("msg_time") <= F.lit(stop).cast("timestamp_ntz")))
    runs = (
        seen.select(
            "newsgroup",
            "msg_time",
            F.ceil(us / F.lit(step)).cast("bigint").alias("first"),
            F.floor((us + F.lit(back)) / F.lit(step)).cast("bigint").alias("last"),
        )
        .filter(F.col("first") <= F.col("last"))
        .groupBy("newsgroup", "first", "last")
        .agg(F.count("*").alias("n"), F.min("msg_time").alias("low"), F.max("msg_time").alias("high"))
    )
    per_tick = (
        runs.select("newsgroup", F.explode(F.sequence("first", "last")).alias("__t"), "n", "low", "high")
        .groupBy("newsgroup", from_micros(F.col("__t") * step + shift).alias("tick"))
        .agg(F.sum("n").alias("n"), F.min("low").alias("first_message"), F.max("high").alias("last_message"))
    )
    grid = tick_grid(feeds, start, stop, period, offset)
    return grid.join(per_tick, ["newsgroup", "tick"], "left").select(
        "newsgroup", "tick", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_msgs"), "first_message", "last_message"
    )


def instrument_status(activity: DataFrame) -> DataFrame:
    """Online where there was any message, else offline."""
    return activity.withColumn("status", F.when(F.col("n_msgs") > 0, "online").otherwise("offline"))


def status_transitions(status: DataFrame) -> DataFrame:
    """What changed at each tick and since when.

    A feed has as many rows as there are ticks, whatever its traffic, so a
    window per feed is even. Going online starts at the tick's first message;
    going offline stops at the last message seen while online. The first tick
    is never a change."""
    w = Window.partitionBy("newsgroup").orderBy("tick")
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before_rows = w.rowsBetween(Window.unboundedPreceding, -1)
    before = F.lag("status").over(w)
    online = F.col("status") == "online"

    base = status.withColumn("previous_status", F.coalesce(before, F.lit("unknown")))
    was = F.col("previous_status")
    base = base.withColumn(
        "__start",
        F.when(online & (was != "online"), F.col("first_message")).when(~online & (was == "unknown"), F.col("tick")),
    ).withColumn(
        "__stop",
        F.when(online & (was == "online"), F.col("last_message"))
        .when(~online & (was == "online"), F.lag("last_message").over(w))
        .when(~online & (was == "unknown"), F.col("tick")),
    )
    timed = base.select(
        "*",
        F.last("__start", ignorenulls=True).over(upto).alias("start_time"),
        F.last("__stop", ignorenulls=True).over(upto).alias("stop_time"),
        F.last("__stop", ignorenulls=True).over(before_rows).alias("__stop_before"),
    )
    ran = F.when(was == "online", elapsed(F.col("start_time"), F.col("stop_time")))
    off = F.when(online & (was == "offline"), elapsed(F.col("__stop_before"), F.col("start_time"))).when(
        ~online & (was == "offline"), elapsed(F.col("stop_time"), F.col("tick"))
    )
    timed = timed.withColumn("__ran", ran).withColumn("__off", off)
    changed = (was != "unknown") & (was != F.col("status"))
    return timed.select(
        "newsgroup",
        "tick",
        "status",
        "previous_status",
        changed.alias("changed"),
        "start_time",
        "stop_time",
        F.when(changed, F.when(online, F.col("start_time")).otherwise(F.col("stop_time"))).alias("change_time"),
        F.coalesce(F.last("__ran", ignorenulls=True).over(upto), F.lit(0.0)).alias("run_time"),
        F.coalesce(F.last("__off", ignorenulls=True).over(upto), F.lit(0.0)).alias("off_time"),
    )


def feed_health(activity: DataFrame, members: DataFrame) -> DataFrame:
    """State of a feed over its groups: all active online, some warning, none offline (or
    error when it should be always on). ``members`` has ``feed, newsgroup, always_on``."""
    active = F.col("n_msgs") > 0
    counted = (
        activity.join(members, "newsgroup")
        .groupBy("feed", "tick")
        .agg(
            F.count("*").alias("n_groups"),
            F.count_if(active).alias("n_active"),
            F.sum("n_msgs").alias("n_msgs"),
            F.bool_or("always_on").alias("__always"),
        )
    )
    state = (
        F.when(F.col("n_active") == F.col("n_groups"), "online")
        .when(F.col("n_active") > 0, "warning")
        .when(F.col("__always"), "error")
        .otherwise("offline")
    )
    return counted.withColumn("state", state).drop("__always")


# ----------------------------------------------------------------- states


def state_intervals(observations: DataFrame, block_size: int = scan.BLOCK) -> DataFrame:
    """Run-length history per member. An interval lasts until the observation that ends
    it; each member begins as ``unknown``, for no time at all."""
    runs = scan.islands(
        observations.select("member", "seq", "ts", "state"),
        ["member"], "seq", ["ts", "state"],
        lambda before, row: before["state"] != row["state"],
        block_size, previous="before", island="run", following="after", narrow=True,
    )
    ends = F.coalesce(F.col("after")["ts"], F.col("ts"))
    intervals = runs.groupBy("member", "run").agg(
        F.min_by("state", "seq").alias("state"),
        F.min_by("ts", "seq").alias("start_time"),
        F.max_by(ends, "seq").alias("last_time"),
        F.bool_or(F.col("after").isNull()).alias("is_open"),
        F.min_by(F.coalesce(F.col("before")["state"], F.lit("unknown")), "seq").alias("previous_state"),
        F.bool_or(F.col("before").isNull()).alias("__first"),
    )
    # The unknown interval before the first observation, unless that one is unknown itself.
    opening = F.struct(
        (F.col("run") - 1).alias("run"),
        F.lit("unknown").alias("state"),
        F.col("start_time").alias("start_time"),
        F.col("start_time").alias("last_time"),
        F.lit(False).alias("is_open"),
        F.lit(None).cast("string").alias("previous_state"),
    )
    own = F.struct("run", "state", "start_time", "last_time", "is_open", "previous_state")
    both = F.when(F.col("__first") & (F.col("state") != "unknown"), F.array(opening, own)).otherwise(F.array(own))
    out = intervals.select("member", F.inline(both))
    return out.withColumn("elapsed", elapsed(F.col("start_time"), F.col("last_time")))


def state_history(intervals: DataFrame, n: int) -> DataFrame:
    """The last n closed intervals of each member, newest index 1."""
    w = Window.partitionBy("member").orderBy(F.desc("run"))
    return (
        intervals.filter(~F.col("is_open"))
        .withColumn("recency", F.row_number().over(w).cast("bigint"))
        .filter(F.col("recency") <= n)
        .select("member", "recency", F.col("state").alias("name"), "start_time", "last_time")
    )


def changed_members(observations: DataFrame) -> DataFrame:
    """Current and previous state of each member, and whether its newest observation changed it.

    Only the two newest observations of a member matter; Spark cuts each partition to them."""
    w = Window.partitionBy("member").orderBy(F.desc("seq"))
    two = observations.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= 2)
    return (
        two.groupBy("member")
        .agg(
            F.max_by("state", "seq").alias("state"),
            F.max("ts").alias("ts"),
            F.coalesce(F.max(F.when(F.col("__r") == 2, F.col("state"))), F.lit("unknown")).alias("previous_state"),
        )
        .withColumn("changed", F.col("state") != F.col("previous_state"))
    )


# ---------------------------------------------------------------- reports


def state_board(states: DataFrame) -> DataFrame:
    """One line per member (``label, state, changed, change_time``) under one subject line.

    The subject and the label width come from a one-row aggregate used as a scalar."""
    subject_text = (
        F.when(F.count_if("changed") > 1, "Multiple instruments have changed status")
        .when(F.count_if("changed") == 1, F.max(F.when(F.col("changed"), F.concat_ws(" ", "label", F.initcap("state")))))
    )
    facts = states.agg(F.struct(subject_text.alias("subject"), F.max(F.length("label")).alias("width"))).scalar()
    subject, width = facts["subject"], facts["width"]
    note = F.when(F.col("changed"), F.concat(F.lit("<-- "), F.col("change_time").cast("string"))).otherwise("")
    padded = F.concat(F.repeat(F.lit(" "), width - F.length("label")), F.col("label"))
    line = F.concat(F.lit("  "), padded, F.lit(": "), F.rpad(F.initcap("state"), 10, " "), F.lit(" "), note)
    return states.select("label", "state", "changed", line.alias("line"), subject.alias("subject"))


def _notice(header: Column, intro: Column, fields: list[tuple[str, Column]], extra: list[Column] = ()) -> Column:
    lines = [F.lit(""), intro, F.lit("")]
    lines += [F.concat(F.lit(f"    {name:<10}: "), F.coalesce(value, F.lit(""))) for name, value in fields]
    lines += [*extra, F.lit("")]
    return F.struct(header.alias("subject"), F.concat_ws("\n", *lines).alias("body"))


def instrument_notices(transitions: DataFrame, start: bool = True, stop: bool = True) -> DataFrame:
    """Start and stop notices of status changes; each kind can be switched off."""
    online = F.col("status") == "online"
    wanted = F.col("changed") & ((online & F.lit(start)) | (~online & F.lit(stop)))
    action = F.when(online, "started").otherwise("stopped")
    spent = F.when(online, F.concat(F.lit("    Offline   : "), F.col("off_time").cast("string"))).otherwise(
        F.concat(F.lit("    Online    : "), F.col("run_time").cast("string"))
    )
    notice = _notice(
        F.concat(F.col("newsgroup"), F.lit(" has "), action),
        F.concat(F.lit("  The following instrument has "), action, F.lit(" sending data:")),
        [("Instrument", F.col("newsgroup")), ("Date/Time", F.col("change_time").cast("string"))],
        [spent],
    )
    return transitions.filter(wanted).select("newsgroup", "tick", notice.alias("n")).select("newsgroup", "tick", "n.*")


def state_notices(intervals: DataFrame, block_size: int = scan.BLOCK) -> DataFrame:
    """Notice of every state a member entered, with the state it left."""
    linked = scan.running(
        intervals.select("member", "run", "state", "start_time", "last_time", "elapsed"),
        ["member"], "run", {"left": scan.previous("state", "start_time", "last_time", "elapsed")}, block_size,
    ).filter(F.col("left").isNotNull())
    label = F.col("member").cast("string")
    action = F.when(F.col("state") == "online", "started").otherwise("stopped")
    left = F.col("left")
    notice = _notice(
        F.concat(label, F.lit(" has "), action),
        F.concat(F.lit("  The following instrument has "), action, F.lit(" sending data:")),
        [
            ("Instrument", label),
            ("Date/Time", strftime(F.col("start_time"), NOTICE_TIME)),
            ("Currently", F.initcap("state")),
        ],
        [
            F.lit(""),
            F.concat(F.lit("  Previous state: "), F.initcap(left["state"])),
            F.concat(F.lit("    Start time: "), strftime(left["start_time"], NOTICE_TIME)),
            F.concat(F.lit("    Stop time : "), strftime(left["last_time"], NOTICE_TIME)),
            F.concat(F.lit("    Elapsed   : "), left["elapsed"].cast("string")),
        ],
    )
    return linked.select("member", "run", notice.alias("n")).select("member", "run", "n.*")


# ------------------------------------------------------------------ cache


def latest_by_feed(messages: DataFrame) -> DataFrame:
    """Newest message of each feed: its number is found on narrow columns, and only the
    messages with that number are looked at whole."""
    newest = messages.groupBy("newsgroup").agg(F.max("article_number").alias("article_number"))
    return join_measured(messages, newest, ["newsgroup", "article_number"]).dropDuplicates(["newsgroup"]).select(messages.columns)


def latest_with_timeout(messages: DataFrame, timeout: str | float, now: str) -> DataFrame:
    """The same, but nothing at all once no feed has had a message for ``timeout``."""
    newest = messages.agg(F.max(micros(F.col("msg_time")))).scalar()
    idle = micros(F.lit(now).cast("timestamp_ntz")) - newest
    return latest_by_feed(messages).filter(idle <= F.lit(duration_micros(timeout)))
