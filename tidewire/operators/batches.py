"""Batching a feed, and what is done with the batches.

Every operator takes messages with ``newsgroup, article_number, msg_time`` and
adds ``batch_id``, which identifies a batch within its feed and grows with the
article numbers. Only metadata passes through here; payloads are joined back
where they are written.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.sizes import size_desc
from tidewire.functions.times import duration, duration_micros, from_micros, micros, strftime
from tidewire.operators import machine
from tidewire.plans import scan
from tidewire.plans.storage import stage

FEED = ["newsgroup"]
REPORT_TIME = "%c UTC +0000"
RULE = "_" * 75


def batch_by_gap(
    messages: DataFrame,
    gap: str | float,
    block_size: int = scan.BLOCK,
    mark_newest: bool = False,
    narrow: bool = False,
) -> DataFrame:
    """A message at least ``gap`` later than the one before it opens a batch; late ones never do.

    ``mark_newest`` adds ``is_newest``, true on the last message of a feed, which tells the
    reports below which batch is open without another look at the feed. ``narrow`` as in scans."""
    limit = duration_micros(gap)
    timed = messages.withColumn("__t", micros(F.col("msg_time")))
    cut = scan.islands(
        timed, FEED, "article_number", ["__t"],
        lambda before, row: row["__t"] - before["__t"] >= F.lit(limit),
        block_size, previous="__prev", island="batch_id", following="__next" if mark_newest else None, narrow=narrow,
    )
    if mark_newest:
        cut = cut.withColumn("is_newest", F.col("__next").isNull())
    return cut.drop("__t", "__prev", "__next")


def span_block(ts: Column, span: str | float) -> Column:
    return F.floor(micros(ts) / F.lit(duration_micros(span)))


def batch_by_span(
    messages: DataFrame, span: str | float, ordered: bool = False, block_size: int = scan.BLOCK
) -> DataFrame:
    """One batch per run of messages in the same epoch-aligned span.

    In a feed whose times never go back (``ordered``) the runs are the spans
    themselves, so no pass over the feed is needed."""
    if ordered:
        return messages.withColumn("batch_id", span_block(F.col("msg_time"), span))
    cut = scan.islands(
        messages.withColumn("__b", span_block(F.col("msg_time"), span)),
        FEED, "article_number", ["__b"],
        lambda before, row: row["__b"] != before["__b"],
        block_size, previous="__prev", island="batch_id",
    )
    return cut.drop("__b", "__prev")


def batch_by_count(messages: DataFrame, n: int, block_size: int = scan.BLOCK) -> DataFrame:
    """Every n messages make a batch; 0 puts a feed into one batch."""
    if n == 0:
        return messages.withColumn("batch_id", F.lit(0).cast("bigint"))
    if n == 1:
        return messages.withColumn("batch_id", F.col("article_number"))
    numbered = scan.running(messages, FEED, "article_number", {"__n": scan.running_count()}, block_size)
    return numbered.withColumn("batch_id", F.floor((F.col("__n") - 1) / F.lit(n))).drop("__n")


def sample_span(
    messages: DataFrame, span: str | float, n: int, ordered: bool = False, block_size: int = scan.BLOCK
) -> DataFrame:
    """Keep the first n messages of each span."""
    batched = batch_by_span(messages, span, ordered, block_size)
    w = Window.partitionBy("newsgroup", "batch_id").orderBy("article_number")
    return batched.withColumn("__n", F.row_number().over(w)).filter(F.col("__n") <= n).drop("__n")


def close_on_timeout(
    messages: DataFrame,
    timeout: str | float,
    now: Column,
    arrival: str = "msg_time",
    block_size: int = scan.BLOCK,
) -> DataFrame:
    """Batches that close when nothing arrives for ``timeout``; one row per batch.

    The newest batch of a feed is closed as well once ``now`` is that far on."""
    rows = messages.select("newsgroup", "article_number", F.col(arrival).alias("msg_time"), "n_bytes")
    batches = batch_table(batch_by_gap(rows, timeout, block_size, mark_newest=True, narrow=True))
    idle = micros(now) - micros(F.col("last_time")) >= F.lit(duration_micros(timeout))
    return batches.withColumn("reason", F.when(~F.col("is_open") | idle, machine.TIMEOUT)).drop("is_open")


@dataclass(frozen=True)
class BatchOptions:
    gap: str | float | None = None
    span: str | float | None = None
    max_messages: int = 0
    start: str | None = None  # times outside [start, stop] are dropped and end the open batch
    stop: str | None = None
    offset: str | float = 0


_ROWS = ["newsgroup", "article_number", "t", "n_bytes"]


def feed_rows(messages: DataFrame, options: BatchOptions, has_files: Column | None = None) -> DataFrame:
    """The narrow rows the batching rule looks at."""
    t = micros(F.col("msg_time")) + F.lit(duration_micros(options.offset))
    in_range = F.lit(True)
    for bound, sign in ((options.start, 1), (options.stop, -1)):
        if bound is not None:
            edge = micros(F.lit(bound).cast("timestamp_ntz"))
            in_range = in_range & ((t - edge) * F.lit(sign) >= 0)
    size = F.col("n_bytes") if "n_bytes" in messages.columns else F.lit(0).cast("bigint")
    return messages.select(
        "newsgroup",
        "article_number",
        t.alias("t"),
        size.alias("n_bytes"),
        in_range.alias("in_range"),
        (F.lit(True) if has_files is None else has_files).alias("has_files"),
    )


def segments(rows: DataFrame, options: BatchOptions, block_size: int = scan.BLOCK) -> DataFrame:
    """Add ``segment``: a new one wherever the batching rule restarts whatever went before.

    That is at and after a message out of range, at a change of span, and
    where the time is a whole gap past every earlier time of the feed."""
    gap = duration_micros(options.gap or 0)
    span = duration_micros(options.span or 0)
    values = ["t", "in_range"]
    if gap:
        rows = scan.running(
            rows, FEED, "article_number", {"peak": scan.running_max(F.col("t"), inclusive=False)}, block_size
        )
        values.append("peak")

    def starts(before: Column, row: Column) -> Column:
        cut = ~row["in_range"] | ~before["in_range"]
        if span:
            cut = cut | (F.floor(row["t"] / F.lit(span)) != F.floor(before["t"] / F.lit(span)))
        if gap:
            cut = cut | (row["t"] - row["peak"] >= F.lit(gap))
        return cut

    return scan.islands(
        rows, FEED, "article_number", values, starts, block_size, previous="before", island="segment", narrow=True
    )


def batch_feed(
    messages: DataFrame,
    options: BatchOptions,
    has_files: Column | None = None,
    carried: DataFrame | None = None,
    block_size: int = scan.BLOCK,
    exact_only: bool = False,
) -> DataFrame:
    """Any mix of gap, span, count and time range: ``newsgroup, article_number, msg_time,
    n_bytes, action, batch_id`` (null unless saved).

    ``has_files`` marks messages that have something to save. ``carried`` has
    the open batch of each feed (``newsgroup, batch_id, n, last``) from an earlier run; then
    the result also tells which batch is open after each message (``open_id, open_n, open_last``).
    """
    gap = duration_micros(options.gap or 0)
    span = duration_micros(options.span or 0)
    limit = options.max_messages
    rows = feed_rows(messages, options, has_files)

    by_gap = gap and not span and not exact_only and (has_files is not None or carried is not None)
    sequential = exact_only or carried is not None or (gap and (has_files is not None or (span and limit)))
    columns = ["newsgroup", "article_number", from_micros(F.col("t")).alias("msg_time"), "n_bytes", "action", "batch_id"]
    if not sequential:
        return _closed_form(rows, options, gap, span, limit, block_size).select(*columns)
    if by_gap:
        out = _gap_form(rows, gap, carried, block_size)
    else:
        out = _sequential(rows, options, gap, span, limit, carried, block_size)
    if carried is not None:
        columns += ["open_id", "open_n", "open_last"]
    return out.select(*columns)


def _closed_form(rows, options, gap, span, limit, block_size) -> DataFrame:
    bounded = options.start is not None or options.stop is not None
    if gap or span or bounded:
        # Without file-less messages the time before is the previous message's.
        def starts(before: Column, row: Column) -> Column:
            cut = ~row["in_range"] | ~before["in_range"]
            if gap:
                cut = cut | (row["t"] - before["t"] >= F.lit(gap))
            if span:
                cut = cut | (F.floor(row["t"] / F.lit(span)) != F.floor(before["t"] / F.lit(span)))
            return cut

        cut = scan.islands(
            rows, FEED, "article_number", ["t", "in_range"], starts, block_size, previous="before", island="run", narrow=True
        )
    else:
        cut = rows.withColumn("run", F.lit(0).cast("bigint"))
    usable = F.col("in_range") & F.col("has_files")
    action = (
        F.when(~F.col("in_range"), machine.OUT_OF_RANGE)
        .when(~F.col("has_files"), machine.SKIPPED)
        .otherwise(machine.SAVED)
    )
    batch = F.col("run")
    if limit and not (gap and not span):
        counted = scan.running(
            cut, ["newsgroup", "run"], "article_number",
            {"__n": scan.running_sum(F.when(usable, 1).otherwise(0).cast("bigint"))}, block_size,
        )
        cut = counted
        if span:
            before = F.col("__n") - F.when(usable, 1).otherwise(0)
            action = F.when(F.col("in_range") & (before >= limit), machine.REJECTED).otherwise(action)
        else:
            batch = F.struct("run", F.floor((F.col("__n") - 1) / F.lit(limit)).alias("part"))
    cut = cut.withColumn("action", action)
    if limit and not gap and not span:
        # Batch ids must grow with the feed: name a batch by its first saved article.
        part = batch["part"]
        first = F.when(usable & ((F.col("__n") - 1) % limit == 0), F.col("article_number"))
        opened = scan.running(
            cut.withColumn("__part", part), FEED, "article_number", {"__id": scan.last_known(first)}, block_size
        )
        return opened.select(*_ROWS, "action", F.when(F.col("action") == machine.SAVED, F.col("__id")).alias("batch_id"))
    return cut.select(*_ROWS, "action", F.when(F.col("action") == machine.SAVED, F.col("run")).alias("batch_id"))


def _gap_form(rows, gap, carried, block_size) -> DataFrame:
    """The rule with a gap and without a span, where the count never closes a batch.

    A batch ends at the first message that is out of range or a gap past the batch's last
    saved message, whether or not it has files itself. So a saved message opens a batch if
    such a message came since the saved one before it. Three blocked scans find that, even
    for a feed that is never idle. Starts jobs when called."""
    if carried is None:
        state = rows.select("*", *(F.lit(None).cast("bigint").alias(c) for c in ("__id", "__n", "__last")))
    else:
        known = carried.filter("n > 0").select(
            "newsgroup", F.col("batch_id").alias("__id"), F.col("n").alias("__n"), F.col("last").alias("__last")
        )
        state = rows.join(known, "newsgroup", "left")
    usable = F.col("in_range") & F.col("has_files")
    here = F.struct(F.col("article_number").alias("at"), F.col("t").alias("t"))
    seen = scan.running(
        state, FEED, "article_number", {"__saved": scan.last_known(F.when(usable, here), inclusive=False)}, block_size
    )
    # what an earlier run left open was saved before all articles of this one
    entered = F.struct(F.lit(-(1 << 63)).cast("bigint").alias("at"), F.col("__last").alias("t"))
    saved = F.coalesce(F.col("__saved"), F.when(F.col("__n").isNotNull(), entered))
    seen = seen.withColumn("__saved", saved)
    ends = ~F.col("in_range") | (F.col("t") - F.col("__saved")["t"] >= F.lit(gap))
    # Each scan reads its input twice. Written out, what two scans share is worked out once.
    seen = stage(seen.withColumn("__ends", F.when(ends, F.col("article_number"))), "seen")
    counted = scan.running(
        seen, FEED, "article_number",
        {"__end": scan.running_max(F.col("__ends")), "__count": scan.running_sum(usable.cast("bigint"))}, block_size,
    )
    goes_on = F.coalesce(F.col("__saved").isNotNull() & ~F.coalesce(F.col("__end") > F.col("__saved")["at"], F.lit(False)), F.lit(False))
    counted = stage(counted.withColumn("__goes_on", goes_on), "counted")
    opened = F.struct(F.col("article_number").alias("id"), (F.col("__count") - 1).alias("before"))
    opening = F.when(usable & ~F.col("__goes_on"), opened)
    placed = scan.running(counted, FEED, "article_number", {"__open": scan.last_known(opening)}, block_size)
    batch = F.coalesce(F.col("__open")["id"], F.col("__id"))
    is_open = usable | F.col("__goes_on")
    action = (
        F.when(~F.col("in_range"), machine.OUT_OF_RANGE)
        .when(~F.col("has_files"), machine.SKIPPED)
        .otherwise(machine.SAVED)
    )

    def while_open(value: Column) -> Column:
        return F.when(is_open, value).otherwise(0).cast("bigint")

    return placed.select(
        *_ROWS,
        action.alias("action"),
        F.when(usable, batch).alias("batch_id"),
        while_open(batch).alias("open_id"),
        while_open(F.col("__count") - F.coalesce(F.col("__open")["before"], -F.col("__n"))).alias("open_n"),
        while_open(F.when(usable, F.col("t")).otherwise(F.col("__saved")["t"])).alias("open_last"),
    )


def _sequential(rows, options, gap, span, limit, carried, block_size) -> DataFrame:
    cut = segments(rows, options, block_size)
    if carried is None:
        first = cut.select(
            "*",
            F.lit(0).cast("bigint").alias("carried_id"),
            F.lit(0).cast("bigint").alias("carried_n"),
            F.lit(0).cast("bigint").alias("carried_last"),
        )
    else:
        state = carried.select(
            "newsgroup",
            F.col("batch_id").alias("__id"),
            F.col("n").alias("__n"),
            F.col("last").alias("__last"),
        )
        opening = F.col("before").isNull() & F.col("__n").isNotNull()
        # Only the row that opens the feed's first segment brings the state in.
        first = cut.join(state, "newsgroup", "left").select(
            *cut.columns,
            F.when(opening, F.col("__id")).otherwise(0).cast("bigint").alias("carried_id"),
            F.when(opening, F.col("__n")).otherwise(0).cast("bigint").alias("carried_n"),
            F.when(opening, F.col("__last")).otherwise(0).cast("bigint").alias("carried_last"),
        )
    ordered = (
        first.select(
            *_ROWS, "segment", "in_range", "has_files", "carried_id", "carried_n", "carried_last"
        )
        .repartition("newsgroup", "segment")
        .sortWithinPartitions("newsgroup", "segment", "article_number")
    )
    ran = ordered.mapInPandas(
        lambda frames: machine.run(frames, gap, span, limit),
        "newsgroup string, article_number bigint, t bigint, n_bytes bigint, action string, batch_id bigint, "
        "saved boolean, open_id bigint, open_n bigint, open_last bigint",
    )
    return ran.withColumn("batch_id", F.when(F.col("saved"), F.col("batch_id"))).drop("saved")


# ---------------------------------------------------------------- reports


def batch_table(batched: DataFrame) -> DataFrame:
    """One row per batch: first and last message time, messages, bytes; ``is_open`` where
    the newest messages are marked."""
    open_batch = [F.bool_or("is_newest").alias("is_open")] if "is_newest" in batched.columns else []
    return batched.groupBy("newsgroup", "batch_id").agg(
        F.min_by("msg_time", "article_number").alias("start_time"),
        F.max_by("msg_time", "article_number").alias("last_time"),
        F.count("*").alias("n_msgs"),
        F.sum("n_bytes").alias("n_bytes"),
        *open_batch,
    )


def file_stats(files: DataFrame, by: tuple[str, ...] = ("newsgroup", "batch_id", "dest")) -> DataFrame:
    """Messages and bytes per archived name."""
    return files.groupBy(*by).agg(F.count("*").alias("n_msgs"), F.sum("n_bytes").alias("n_bytes"))


def batch_report(batched: DataFrame, reason: str) -> DataFrame:
    """Per batch its figures and why it was closed; the newest batch of a feed is still open.

    With marked newest messages one pass does; else the newest batch of each feed is joined."""
    batches = batch_table(batched)
    if "is_open" in batches.columns:
        return batches.withColumn("reason", F.when(~F.col("is_open"), reason)).drop("is_open")
    newest = batched.groupBy("newsgroup").agg(F.max("batch_id").alias("__newest"))
    return (
        batches.join(newest, "newsgroup")
        .withColumn("reason", F.when(F.col("batch_id") < F.col("__newest"), reason))
        .drop("__newest")
    )


def closing_reasons(placed: DataFrame, options: BatchOptions, block_size: int = scan.BLOCK) -> DataFrame:
    """Why each closed batch of a :func:`batch_feed` result was closed: ``newsgroup, batch_id, reason``.

    While a batch is open the rule looks back at its last saved message only. So the first
    later message that is out of range, a gap or another span away from that one is what
    closed it; one blocked scan carries the last saved message along. A batch closed by
    count is full."""
    gap, span, limit = duration_micros(options.gap or 0), duration_micros(options.span or 0), options.max_messages
    t, saved = micros(F.col("msg_time")), F.col("action") == machine.SAVED
    last = scan.last_known(F.when(saved, F.struct("batch_id", t.alias("t"))), inclusive=False)
    rows = placed.select("newsgroup", "article_number", "msg_time", "action", "batch_id")
    seen = scan.running(rows, ["newsgroup"], "article_number", {"__saved": last}, block_size).filter("__saved IS NOT NULL")
    before = F.col("__saved")["t"]
    reason = F.when(F.col("action") == machine.OUT_OF_RANGE, machine.RANGE)
    if gap:
        reason = reason.when(t - before >= gap, machine.GAP)
    if span:
        reason = reason.when(F.floor(t / F.lit(span)) != F.floor(before / F.lit(span)), machine.SPAN)
    closing = seen.select("newsgroup", F.col("__saved")["batch_id"].alias("batch_id"), "article_number", reason.alias("reason"))
    closed = closing.filter("reason IS NOT NULL").groupBy("newsgroup", "batch_id").agg(F.min_by("reason", "article_number").alias("reason"))
    if not limit or gap or span:
        return closed
    full = placed.filter(saved).groupBy("newsgroup", "batch_id").count().filter(F.col("count") >= limit)
    full = full.select("newsgroup", "batch_id", F.lit(machine.COUNT).alias("full"))
    both = closed.join(full, ["newsgroup", "batch_id"], "full_outer")
    return both.select("newsgroup", "batch_id", F.coalesce("full", "reason").alias("reason"))


def feed_report(placed: DataFrame, options: BatchOptions, block_size: int = scan.BLOCK) -> DataFrame:
    """Per batch of a :func:`batch_feed` result its figures and why it was closed; null while it is open.

    What became of the messages is written to the shared folder first (narrow rows), so that the
    batching rule runs once for the figures and the reasons. Starts a job when called."""
    placed = stage(placed, "placed")
    batches = batch_table(placed.filter(F.col("action") == machine.SAVED))
    return batches.join(closing_reasons(placed, options, block_size), ["newsgroup", "batch_id"], "left")


def _file_line(prefix: Column) -> Column:
    units = F.when(F.col("n_msgs") > 1, "msgs").otherwise("msg")
    return F.concat(
        prefix, F.col("dest"), F.lit(": "), size_desc(F.col("n_bytes")), F.lit(" ("), F.col("n_msgs").cast("string"),
        F.lit(" "), units, F.lit(")"),
    )


def batch_report_lines(report: DataFrame, stats: DataFrame, title: str) -> DataFrame:
    """The report as text, one row per line, so that a batch of any size stays in many rows.

    Lines of a report come in the order of ``part, dest, line_no``."""
    field = lambda name, value: F.concat(F.lit(f"    {name:<14}: "), value)
    head = [
        F.lit(RULE),
        F.lit(title),
        F.lit(""),
        field("Newsgroup", F.col("newsgroup")),
        field("Beginning", strftime(F.col("start_time"), REPORT_TIME)),
        field("Ending", strftime(F.col("last_time"), REPORT_TIME)),
        field("Messages", F.col("n_msgs").cast("string")),
        field("Total bytes", size_desc(F.col("n_bytes"))),
        field("Reason", F.coalesce("reason", F.lit(""))),
        F.lit(""),
        F.lit("    Filenames"),
        F.lit("    ---------"),
    ]
    keys = ["newsgroup", "batch_id"]

    def lines(source: DataFrame, part: int, texts: list[Column]) -> DataFrame:
        return source.select(
            *keys, F.lit(part).alias("part"), F.lit("").alias("dest"), F.posexplode(F.array(*texts)).alias("line_no", "line")
        )

    files = stats.select(*keys, F.lit(1).alias("part"), "dest", F.lit(0).alias("line_no"), _file_line(F.lit("    ")).alias("line"))
    return lines(report, 0, head).unionByName(files).unionByName(lines(report, 2, [F.lit(RULE)]))


def closing_times(batches: DataFrame, block_size: int = scan.BLOCK) -> DataFrame:
    """Add ``close_time``: the start of the next batch, whose first message closed this one."""
    backwards = batches.withColumn("__back", -F.col("batch_id"))
    nxt = scan.running(backwards, FEED, "__back", {"__next": scan.previous("start_time")}, block_size)
    return nxt.withColumn("close_time", F.col("__next")["start_time"]).drop("__next", "__back")


def summary_period(ts: Column, period: str | float, offset: str | float = 0) -> Column:
    """Start of the period (aligned to period + offset) a time falls into."""
    step, shift = duration_micros(period), duration_micros(offset)
    us = micros(ts) - F.lit(shift)
    return from_micros(F.floor(us / F.lit(step)) * F.lit(step) + F.lit(shift))


def summary_report(closed: DataFrame, period: str | float, offset: str | float = 0) -> DataFrame:
    """Closed batches (with ``close_time``) per feed and period: batches, messages, bytes."""
    return (
        closed.filter(F.col("close_time").isNotNull())
        .groupBy("newsgroup", summary_period(F.col("close_time"), period, offset).alias("period_start"))
        .agg(
            F.count("*").alias("n_batches"),
            F.sum("n_msgs").alias("n_msgs"),
            F.sum("n_bytes").alias("n_bytes"),
        )
    )


def summary_files(closed: DataFrame, period: str | float, offset: str | float = 0, max_files: int | None = None) -> DataFrame:
    """The closed batches of each feed and period, to list their files; with ``max_files`` the last so many."""
    w = Window.partitionBy("newsgroup", "period_start").orderBy(F.desc("batch_id"))
    return (
        closed.filter(F.col("close_time").isNotNull())
        .withColumn("period_start", summary_period(F.col("close_time"), period, offset))
        .withColumn("recency", F.row_number().over(w).cast("bigint"))
        .filter(F.lit(True) if max_files is None else F.col("recency") <= max_files)
    )


def summary_lines(summary: DataFrame, listed: DataFrame, stats: DataFrame, title: str, period: str | float) -> DataFrame:
    """The summary as text, one row per line, ordered by ``part, recency desc, dest, line_no``."""
    field = lambda name, value: F.concat(F.lit(f"    {name:<14}: "), value)
    ending = from_micros(micros(F.col("period_start")) + F.lit(duration_micros(period)))
    head = [
        F.lit(RULE),
        F.lit(title),
        F.lit(""),
        field("Newsgroup", F.col("newsgroup")),
        field("Beginning", strftime(F.col("period_start"), REPORT_TIME)),
        field("Ending", strftime(ending, REPORT_TIME)),
        field("Messages", F.col("n_msgs").cast("string")),
        field("Total bytes", size_desc(F.col("n_bytes"))),
        F.lit(""),
        F.lit("    Filenames"),
        F.lit("    ---------"),
    ]
    keys = ["newsgroup", "period_start"]

    def lines(part: int, texts: list[Column]) -> DataFrame:
        return summary.select(
            *keys, F.lit(part).alias("part"), F.lit(0).cast("bigint").alias("recency"), F.lit("").alias("dest"),
            F.posexplode(F.array(*texts)).alias("line_no", "line"),
        )

    first = listed.select("newsgroup", "batch_id", "period_start", "recency")
    named = stats.join(first, ["newsgroup", "batch_id"])
    leading = named.groupBy("newsgroup", "batch_id").agg(F.min("dest").alias("__lead"))
    prefix = F.when(F.col("dest") == F.col("__lead"), "  - ").otherwise("    ")
    files = named.join(leading, ["newsgroup", "batch_id"]).select(
        *keys, F.lit(1).alias("part"), "recency", "dest", F.lit(0).alias("line_no"), _file_line(prefix).alias("line")
    )
    return lines(0, head).unionByName(files).unionByName(lines(2, [F.lit(RULE)]))


# -------------------------------------------------------------- retention


def keep_history(batches: DataFrame, n: int) -> DataFrame:
    """The current batch (index 0) and n previous ones; 0 rolls and deletes nothing."""
    if n == 0:
        return batches.withColumn("history_index", F.lit(0).cast("bigint"))
    w = Window.partitionBy("newsgroup").orderBy(F.desc("batch_id"))
    return (
        batches.withColumn("__r", F.row_number().over(w))
        .filter(F.col("__r") <= n + 1)
        .withColumn("history_index", (F.col("__r") - 1).cast("bigint"))
        .drop("__r")
    )


def expire(batches: DataFrame, ttl: str | float, now: Column, history: int) -> DataFrame:
    """The batches whose files are deleted: of the newest ``history + 1`` closed batches
    of a feed, oldest first, those last written more than ``ttl`` ago, up to the first
    that is not. The open batch (the newest) never expires."""
    w = Window.partitionBy("newsgroup").orderBy(F.desc("batch_id"))
    examined = (
        batches.withColumn("__r", F.row_number().over(w))
        .filter(F.col("__r") <= history + 2)
        .filter(F.col("__r") > 1)
        .withColumn("__old", micros(now) - micros(F.col("last_time")) > F.lit(duration_micros(ttl)))
    )
    oldest_first = Window.partitionBy("newsgroup").orderBy("batch_id")
    kept_before = F.max(F.when(F.col("__old"), 0).otherwise(1)).over(
        oldest_first.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return examined.withColumn("__kept", kept_before).filter(F.col("__kept") == 0).drop("__r", "__old", "__kept")


def retained(batches: DataFrame, ttl: str | float, now: Column, history: int) -> DataFrame:
    """The batches that are left after :func:`expire`."""
    gone = expire(batches, ttl, now, history).select("newsgroup", "batch_id")
    return batches.join(gone, ["newsgroup", "batch_id"], "left_anti")


def seconds_of(value: str | float) -> float:
    return duration(value)
