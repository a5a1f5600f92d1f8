"""Time series from status snapshots.

Samples are ``plotgroup, variable, ts, value`` with an order column ``seq``.
A sample speaks for the time since the sample before it, unless that is
longer ago than the timeout; then nothing is known in between.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.globs import to_regex
from tidewire.functions.times import duration_micros, from_micros, micros
from tidewire.plans import scan
from tidewire.plans.joins import newest_of
from tidewire.sources.snapshots import snapshot_entries, snapshot_value

SERIES = ["plotgroup", "variable"]
# Half of a step must be known for its value to be.
KNOWN_FRACTION = 0.5


@dataclass(frozen=True)
class Variable:
    """A variable to take from snapshots; key defaults to its name."""

    plotgroup: str
    name: str
    section: str = "DEFAULT"
    key: str | None = None
    headers: Mapping[str, str] = field(default_factory=dict)
    filter: bool = False
    minimum: float | None = None
    maximum: float | None = None


def _configured(variables: Sequence[Variable], group_headers: Mapping[str, Mapping[str, str]]) -> Column:
    """The configured variables as one array literal, to be exploded next to each message."""
    out = []
    for v in variables:
        required = {k.lower(): p for k, p in {**group_headers.get(v.plotgroup, {}), **v.headers}.items()}
        tests = F.array(
            *[F.struct(F.lit(h).alias("name"), F.lit(to_regex(p)).alias("regex")) for h, p in sorted(required.items())]
        ).cast("array<struct<name:string,regex:string>>")
        out.append(
            F.struct(
                F.lit(v.plotgroup).alias("plotgroup"),
                F.lit(v.name).alias("variable"),
                F.lit(v.section).alias("section"),
                F.lit((v.key or v.name).lower()).alias("key"),
                tests.alias("required"),
                F.lit(v.filter).alias("filter"),
                F.lit(v.minimum).cast("double").alias("minimum"),
                F.lit(v.maximum).cast("double").alias("maximum"),
            )
        )
    return F.array(*out)


def numeric_text(text: Column) -> Column:
    """The text without letters and punctuation other than + - and dot."""
    return F.trim(F.regexp_replace(text, r"[^0-9+.\s-]", ""))


def numeric_filter(text: Column) -> Column:
    """The number left in a text, null when none is."""
    return numeric_text(text).try_cast("double")


def valid_range(value: Column, minimum: float | Column | None = None, maximum: float | Column | None = None) -> Column:
    """Null outside [minimum, maximum]; a bound that is None (or null) does not apply."""
    for bound, keep in ((minimum, lambda b: value >= b), (maximum, lambda b: value <= b)):
        if bound is not None:
            limit = bound if isinstance(bound, Column) else F.lit(bound)
            value = F.when(F.coalesce(keep(limit), limit.isNull()), value)
    return value


def extract_variables(
    messages: DataFrame,
    variables: Sequence[Variable],
    group_headers: Mapping[str, Mapping[str, str]] | None = None,
    missing: str = "skip",
) -> DataFrame:
    """Samples of the configured variables in each message (``headers``, ``body``).

    No join and no shuffle: the snapshot is parsed in its row and each variable
    looked up in it. Variables a message lacks are skipped, or kept with
    ``found`` false where ``missing="report"``."""
    configured = _configured(variables, group_headers or {})
    parsed = messages.select(
        "newsgroup", "article_number", "msg_time", "headers",
        snapshot_entries(F.col("body")).alias("entries"), configured.alias("configured"),
    )
    parsed = parsed.select("*", F.explode("configured").alias("v")).drop("configured")
    fits = F.forall(
        F.col("v")["required"],
        lambda r: F.coalesce(F.rlike(F.element_at(F.col("headers"), r["name"]), r["regex"]), F.lit(False)),
    )
    text = snapshot_value(F.col("entries"), F.col("v")["section"], F.col("v")["key"])
    read = parsed.filter(fits).select(
        F.col("v")["plotgroup"].alias("plotgroup"),
        F.col("v")["variable"].alias("variable"),
        "newsgroup",
        F.col("article_number").alias("seq"),
        F.col("msg_time").alias("ts"),
        text.alias("text"),
        F.col("v").alias("v"),
    )
    if missing == "skip":
        read = read.filter(F.col("text").isNotNull())
    number = F.when(F.col("v")["filter"], numeric_filter(F.col("text"))).otherwise(F.trim("text").try_cast("double"))
    ranged = valid_range(number, F.col("v")["minimum"], F.col("v")["maximum"])
    return read.select(
        *SERIES, "newsgroup", "seq", "ts", F.col("text").isNotNull().alias("found"), ranged.alias("value")
    )


def known_intervals(
    samples: DataFrame, timeout: str | float, order: str = "seq", block_size: int = scan.BLOCK, peak: str | None = None
) -> DataFrame:
    """Per sample the time it speaks for: (``since``, ``until``] in microseconds, from the
    latest time so far, so that no time counts twice when samples come out of order. Samples
    after more than ``timeout``, the first of a series, samples behind a later one and
    unknown values speak for none. ``peak`` names a column with the latest time (microseconds)
    of the series' samples before these, where they are not the first."""
    rows = samples.withColumn("until", micros(F.col("ts")))
    linked = scan.running(rows, SERIES, order, {"__before": scan.running_max(F.col("until"), inclusive=False)}, block_size)
    since = F.col("__before") if peak is None else F.greatest("__before", peak)
    known = F.col("value").isNotNull() & (F.col("until") > since) & (F.col("until") - since <= duration_micros(timeout))
    return linked.withColumn("since", since).filter(known).drop("__before")


def resample(
    samples: DataFrame,
    step: str | float,
    function: str = "AVERAGE",
    timeout: str | float | None = None,
    order: str = "seq",
    block_size: int = scan.BLOCK,
) -> DataFrame:
    """One value per series and step, null where less than half of the step is known.

    Each known interval is cut at step boundaries; as it is no longer than the
    timeout, it touches a bounded number of steps."""
    width = duration_micros(step)
    intervals = known_intervals(samples, step if timeout is None else timeout, order, block_size)
    first = F.floor(F.col("since") / F.lit(width))
    last = F.floor((F.col("until") - 1) / F.lit(width))
    pieces = intervals.select(
        *SERIES, order, "value", "since", "until", F.explode(F.sequence(first, last)).alias("step_no")
    )
    begin, end = F.col("step_no") * width, (F.col("step_no") + 1) * width
    covered = F.least("until", end) - F.greatest("since", begin)
    value = {
        "AVERAGE": F.sum(F.col("value") * covered) / F.sum(covered),
        "MIN": F.min("value"),
        "MAX": F.max("value"),
        "LAST": F.max_by("value", order),
    }[function.upper()]
    return (
        pieces.groupBy(*SERIES, "step_no")
        .agg(value.alias("__v"), F.sum(covered).alias("known"))
        .select(
            *SERIES,
            from_micros(F.col("step_no") * width).alias("ts"),
            F.when(F.col("known") >= KNOWN_FRACTION * width, F.col("__v")).alias("value"),
        )
    )


def mark_gaps(
    samples: DataFrame, timeout: str | float, order: str = "seq", block_size: int = scan.BLOCK, now: str | None = None
) -> DataFrame:
    """Samples plus an unknown one ``timeout`` after each that has no successor by then; after
    a series' last sample only if ``now`` is given and later than that."""
    limit = duration_micros(timeout)
    linked = scan.running(samples, SERIES, order, {"__before": scan.previous("ts")}, block_size)
    before = micros(F.col("__before")["ts"])
    own = F.struct("ts", "value")
    gap = F.struct(from_micros(before + limit).alias("ts"), F.lit(None).cast("double").alias("value"))
    late = F.coalesce(micros(F.col("ts")) - before > limit, F.lit(False))
    marked = linked.select(*SERIES, order, F.inline(F.when(late, F.array(gap, own)).otherwise(F.array(own))))
    if now is None:
        return marked
    last = samples.groupBy(*SERIES).agg(F.max(order).alias(order), F.max_by("ts", order).alias("ts"))
    ended = last.filter(micros(F.lit(now).cast("timestamp_ntz")) - micros(F.col("ts")) > limit)
    unknown = ended.select(*SERIES, order, from_micros(micros(F.col("ts")) + limit).alias("ts"), F.lit(None).cast("double").alias("value"))
    return marked.unionByName(unknown)


def retain(samples: DataFrame, duration: str | float) -> DataFrame:
    """The newest ``duration`` of each series."""
    return newest_of(samples, SERIES, "ts", duration_micros(duration), "<")


def bounded_series(samples: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Samples from start to end; plain comparisons that reach the scan."""
    if start is not None:
        samples = samples.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        samples = samples.filter(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return samples


def period_series(
    samples: DataFrame,
    periods: Sequence[tuple[str, str, str]],
    end: str,
    timeout: str | float,
    block_size: int = scan.BLOCK,
) -> DataFrame:
    """One series per variable and period (name, span, step) ending at ``end``."""
    out = None
    for name, span, step in periods:
        start = F.lit(end).cast("timestamp_ntz") - F.expr(f"INTERVAL {duration_micros(span)} MICROSECOND")
        part = samples.filter((F.col("ts") > start) & (F.col("ts") <= F.lit(end).cast("timestamp_ntz")))
        series = resample(part, step, timeout=timeout, block_size=block_size).withColumn("period", F.lit(name))
        out = series if out is None else out.unionByName(series)
    return out


def derived_series(series: DataFrame, variables: Sequence[str], expressions: Mapping[str, str]) -> DataFrame:
    """New variables from SQL expressions over others at the same time (which need not be shown)."""
    wide = series.groupBy("plotgroup", "ts").pivot("variable", list(variables)).agg(F.first("value"))
    return wide.select("plotgroup", "ts", *[F.expr(e).alias(name) for name, e in expressions.items()])


def stacked_series(series: DataFrame, variables: Sequence[str], offset: float = 0.0) -> DataFrame:
    """Each variable on top of those listed before it, raised by offset x position."""
    position = F.array_position(F.array(*[F.lit(v) for v in variables]), F.col("variable")) - 1
    w = Window.partitionBy("plotgroup", "ts").orderBy("__i").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        series.filter(F.col("variable").isin(list(variables)))
        .withColumn("__i", position)
        .withColumn("stacked", F.sum(F.coalesce("value", F.lit(0.0))).over(w) + F.col("__i") * F.lit(offset))
        .drop("__i")
    )
