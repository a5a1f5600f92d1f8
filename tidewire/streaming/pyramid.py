"""Time series kept as steps of several widths.

A step's state says what its known time adds up to: microseconds known, value times
microseconds, lowest, highest and last value. States of parts of a step add up to
the step's, so samples are read once, into the narrowest steps, and wider steps are
made of narrower ones.

An interval that begins at or before its step, or ends behind it, stays apart in the
state (``edges``, two at most), until a wider step holds it whole. So a period may
begin or end at any step and leave out, as ``period_series`` does, what reaches across.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.times import duration, duration_micros, from_micros, micros
from tidewire.operators.series import KNOWN_FRACTION, SERIES, known_intervals
from tidewire.plans import scan
from tidewire.streaming.epochs import FoldedTable

_NAMES = "plotgroup string, variable string"
_LAST = "struct<seq:bigint,value:double>"
STATE = (
    f"{_NAMES}, step_no bigint, known bigint, area double, low double, high double, last {_LAST}, "
    "edges array<struct<since:bigint,until:bigint,known:bigint,value:double,seq:bigint>>"
)


def _last(seq: Column, value: Column) -> Column:
    return F.struct(seq.alias("seq"), value.alias("value"))


def finest(intervals: DataFrame, width: int, order: str) -> DataFrame:
    """The states of the steps that known intervals (``since, until, value``) touch."""
    first, last = F.floor(F.col("since") / F.lit(width)), F.floor((F.col("until") - 1) / F.lit(width))
    pieces = intervals.select(*SERIES, F.col(order).alias("seq"), "value", "since", "until", F.explode(F.sequence(first, last)).alias("step_no"))
    begin, end = F.col("step_no") * width, (F.col("step_no") + 1) * width
    covered = F.least("until", end) - F.greatest("since", begin)
    inside = (F.col("since") > begin) & (F.col("until") <= end)
    edge = F.struct("since", "until", covered.alias("known"), "value", "seq")
    return pieces.groupBy(*SERIES, "step_no").agg(
        F.coalesce(F.sum(F.when(inside, covered)), F.lit(0)).alias("known"),
        F.coalesce(F.sum(F.when(inside, F.col("value") * covered)), F.lit(0.0)).alias("area"),
        F.min(F.when(inside, F.col("value"))).alias("low"),
        F.max(F.when(inside, F.col("value"))).alias("high"),
        F.max(F.when(inside, _last(F.col("seq"), F.col("value")))).alias("last"),
        F.collect_list(F.when(~inside, edge)).alias("edges"),
    )


def _with_edges(states: DataFrame, taken: Column) -> DataFrame:
    """States with the edges of the array ``taken`` counted in; their own ``edges`` are as before."""
    states = states.withColumn("__taken", taken)
    known = F.aggregate("__taken", F.lit(0).cast("bigint"), lambda a, e: a + e["known"])
    area = F.aggregate("__taken", F.lit(0.0), lambda a, e: a + e["value"] * e["known"])
    values = F.transform("__taken", lambda e: e["value"])
    lasts = F.transform("__taken", lambda e: _last(e["seq"], e["value"]))
    return states.select(
        *SERIES, "step_no",
        (F.col("known") + known).alias("known"),
        (F.col("area") + area).alias("area"),
        F.least("low", F.array_min(values)).alias("low"),
        F.greatest("high", F.array_max(values)).alias("high"),
        F.array_max(F.array_append(lasts, F.col("last"))).alias("last"),
        "edges",
    )


def _one(edges: Column, which) -> Column:
    """The pieces of one interval as one edge; null where there are none."""
    part = F.filter(edges, which)
    known = F.aggregate(part, F.lit(0).cast("bigint"), lambda a, e: a + e["known"])
    one = F.struct(part[0]["since"].alias("since"), part[0]["until"].alias("until"), known.alias("known"), part[0]["value"].alias("value"), part[0]["seq"].alias("seq"))
    return F.when(F.size(part) > 0, one)


def wider(states: DataFrame, width: int, factor: int = 1) -> DataFrame:
    """States of ``factor`` steps as those of one step of ``width``; with a factor of 1, several
    states of the same step as one."""
    begin, end = F.col("step_no") * width, (F.col("step_no") + 1) * width
    summed = (
        states.withColumn("step_no", F.floor(F.col("step_no") / F.lit(factor)))
        .groupBy(*SERIES, "step_no")
        .agg(
            F.sum("known").alias("known"), F.sum("area").alias("area"), F.min("low").alias("low"), F.max("high").alias("high"),
            F.max("last").alias("last"), F.flatten(F.collect_list("edges")).alias("edges"),
        )
    )
    inside = F.filter("edges", lambda e: (e["since"] > begin) & (e["until"] <= end))
    # intervals of a series do not overlap: one at most lies across the begin, one across the end
    across = F.array(
        _one(F.col("edges"), lambda e: e["since"] <= begin),
        _one(F.col("edges"), lambda e: (e["since"] > begin) & (e["until"] > end)),
    )
    return _with_edges(summed, inside).withColumn("edges", F.array_compact(across))


def _bound(time: str, width: int) -> int:
    """Microseconds since the epoch of a time without zone, which must be the bound of a step."""
    us = (datetime.fromisoformat(time) - datetime(1970, 1, 1)) // timedelta(microseconds=1)
    if us % width:
        raise ValueError(f"{time} is no bound of a step of {width} microseconds")
    return us


class SeriesPyramid:
    """Samples (``plotgroup, variable, ts, value`` and an order column) as steps of several widths.

    ``steps`` go from the narrowest to the widest, each a multiple of the one before; ``retain``
    says how far back from a series' latest time each is kept. A micro-batch reads its own samples and
    writes the states of the steps they touch. Samples come in their order; as in
    ``known_intervals``, one behind a later one speaks for no time."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        steps: Sequence[str | float],
        timeout: str | float,
        retain: Sequence[str | float] | None = None,
        order: str = "seq",
        block_size: int = scan.BLOCK,
        every: int = 16,
    ):
        self.widths = [duration_micros(s) for s in steps]
        for narrow, wide in zip(self.widths, self.widths[1:]):
            if wide <= narrow or wide % narrow:
                raise ValueError("every step must be a multiple of the one before")
        if retain is not None and len(retain) != len(steps):
            raise ValueError("give a duration for each step")
        self.retain = retain and [duration_micros(r) for r in retain]
        self.timeout, self.order, self.block_size = duration(timeout), order, block_size
        self.peaks = FoldedTable(
            spark, f"{root}/peaks", f"{_NAMES}, peak bigint", lambda p: p.groupBy(*SERIES).agg(F.max("peak").alias("peak")), every
        )
        self.levels = [
            FoldedTable(spark, f"{root}/step={i}", STATE, lambda s, width=width: wider(s, width), every) for i, width in enumerate(self.widths)
        ]

    def apply(self, batch: DataFrame, epoch: int) -> None:
        before = self.peaks.current(epoch - 1).select(*[F.col(c).alias(f"__{c}") for c in SERIES], "peak")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SERIES]
        rows = batch.join(before, same[0] & same[1], "left").drop(*[f"__{c}" for c in SERIES])
        intervals = known_intervals(rows, self.timeout, self.order, self.block_size, peak="peak")
        self.peaks.add(batch.groupBy(*SERIES).agg(F.max(micros(F.col("ts"))).alias("peak")), epoch)
        touched = finest(intervals, self.widths[0], self.order)
        for i, level in enumerate(self.levels):
            if i:
                touched = wider(touched, self.widths[i], self.widths[i] // self.widths[i - 1])
            touched = level.add(touched, epoch, lambda states, i=i: self._kept(states, i, epoch))

    def _kept(self, states: DataFrame, level: int, epoch: int) -> DataFrame:
        """The steps that end less than the level's duration before the series' latest time."""
        if self.retain is None:
            return states
        peaks = self.peaks.current(epoch).select(*[F.col(c).alias(f"__{c}") for c in SERIES], "peak")
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in SERIES]
        held = states.join(peaks, same[0] & same[1])
        end = (F.col("step_no") + 1) * self.widths[level]
        return held.filter(F.col("peak") - end < self.retain[level]).select(*states.columns)

    def series(self, epoch: int, step: str | float, function: str = "AVERAGE", start: str | None = None, end: str | None = None) -> DataFrame:
        """``resample`` by a step of the pyramid, of all samples until a micro-batch or of those
        after ``start`` and not after ``end``, which must be the bounds of steps."""
        width = duration_micros(step)
        level = self.widths.index(width)
        states = self.levels[level].parts(epoch)
        first, last = (None if t is None else _bound(t, width) for t in (start, end))
        if first is not None:
            states = states.filter(F.col("step_no") >= first // width)
        if last is not None:
            states = states.filter(F.col("step_no") < last // width)
        states = self._kept(self.levels[level].fold(states), level, epoch)

        def whole(edge: Column) -> Column:
            after = F.lit(True) if first is None else edge["since"] > first
            return after if last is None else after & (edge["until"] <= last)

        taken = F.filter("edges", whole)
        full = _with_edges(states, taken).filter(F.col("known") > 0)
        value = {
            "AVERAGE": F.col("area") / F.col("known"),
            "MIN": F.col("low"),
            "MAX": F.col("high"),
            "LAST": F.col("last")["value"],
        }[function.upper()]
        return full.select(
            *SERIES,
            from_micros(F.col("step_no") * width).alias("ts"),
            F.when(F.col("known") >= KNOWN_FRACTION * width, value).alias("value"),
        )

    def periods(self, epoch: int, periods: Sequence[tuple[str, str, str]], end: str, function: str = "AVERAGE") -> DataFrame:
        """``period_series`` of the samples until a micro-batch: (name, span, step) ending at ``end``."""
        out = None
        for name, span, step in periods:
            start = (datetime.fromisoformat(end) - timedelta(microseconds=duration_micros(span))).isoformat(sep=" ")
            part = self.series(epoch, step, function, start, end).withColumn("period", F.lit(name))
            out = part if out is None else out.unionByName(part)
        return out
