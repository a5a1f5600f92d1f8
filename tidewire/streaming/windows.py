"""Windows by event time: what comes in time is counted once and for good, what comes late is kept aside.

Spark's watermark drops late rows without a word. ``OnTime`` goes before it: it holds
every row against the latest time of the micro-batches before and stores it with the rows
in time or with the late ones. Queries over the rows in time then have a watermark
that never runs ahead of that, so that they lose none, and their state stays bounded.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.functions.times import duration_micros, from_micros, micros
from tidewire.streaming.epochs import EpochTable


class OnTime:
    """Rows in time and late rows of a stream, by a time column.

    A row is late if its time lies before the latest time of all micro-batches before, less
    ``delay``; one without a time counts as late. Each row gets into one of the tables
    ``on_time`` and ``late``, also where a micro-batch runs again."""

    def __init__(self, spark: SparkSession, root: str, schema: str, delay: str | float, time: str = "msg_time"):
        self.delay, self.time = duration_micros(delay), time
        self.on_time = EpochTable(spark, f"{root}/on_time", schema)
        self.late = EpochTable(spark, f"{root}/late", schema)
        self.newest = EpochTable(spark, f"{root}/newest", "newest bigint")

    def _newest(self, epoch: int) -> int | None:
        row = self.newest.read(epoch).first()
        return row.newest if row else None

    def apply(self, batch: DataFrame, epoch: int) -> None:
        before = self._newest(epoch - 1)
        time = micros(F.col(self.time))
        timely = time.isNotNull() if before is None else F.coalesce(time >= before - self.delay, F.lit(False))
        columns = self.on_time.read(-1).columns
        stored = self.on_time.write_once(batch.filter(timely).select(*columns), epoch)
        self.late.write(batch.filter(~timely).select(*columns), epoch)
        latest = stored.agg(F.greatest(F.max(time), F.lit(before).cast("bigint")).alias("newest"))
        self.newest.write(latest, epoch)

    def stream(self) -> DataFrame:
        """The rows in time as a stream of their own, each with its ``epoch``."""
        return self.on_time.spark.readStream.schema(f"{self.on_time.schema}, epoch bigint").parquet(self.on_time.root)

    def watermark(self, epoch: int) -> int | None:
        """What ended by then (microseconds) is final after a micro-batch."""
        newest = self._newest(epoch)
        return None if newest is None else (newest // 1000 - _delay_millis(self.delay)) * 1000


def _delay_millis(delay: int) -> int:
    """Spark's watermark counts milliseconds. One more keeps it behind all that is in time, so
    that no such row touches a session already given."""
    return -(-delay // 1000) + 1


def _marked(rows: DataFrame, delay: str | float, time: str) -> DataFrame:
    zoned = rows.withColumn(time, F.col(time).cast("timestamp"))
    return zoned.withWatermark(time, f"{_delay_millis(duration_micros(delay))} milliseconds") if rows.isStreaming else zoned


def _bounds(window: Column) -> list[Column]:
    return [from_micros(micros(window[side])).alias(f"{side}_time") for side in ("start", "end")]


def period_counts(
    messages: DataFrame, period: str | float, offset: str | float = 0, delay: str | float = 0, time: str = "msg_time"
) -> DataFrame:
    """Messages and bytes (``newsgroup, n_bytes``) of each feed and period, aligned to period and
    offset. On a stream a period is given when its end is more than ``delay`` behind the latest time."""
    width, shift = duration_micros(period), duration_micros(offset) % duration_micros(period)
    window = F.window(time, f"{width} microseconds", f"{width} microseconds", f"{shift} microseconds")
    counted = _marked(messages, delay, time).groupBy("newsgroup", window.alias("w"))
    counted = counted.agg(F.count("*").alias("n_msgs"), F.sum("n_bytes").alias("n_bytes"))
    return counted.select("newsgroup", *_bounds(F.col("w")), "n_msgs", "n_bytes")


def sessions(messages: DataFrame, gap: str | float, delay: str | float = 0, time: str = "msg_time") -> DataFrame:
    """Messages and bytes of each feed between silences of at least ``gap``, in the order of time,
    with the first and the last time. On a stream a session is given when the gap behind it is
    more than ``delay`` behind the latest time."""
    # sessions that touch are one for Spark; a message just a gap later opens a new one here
    window = F.session_window(time, f"{duration_micros(gap) - 1} microseconds")
    counted = _marked(messages, delay, time).groupBy("newsgroup", window.alias("w"))
    counted = counted.agg(F.count("*").alias("n_msgs"), F.sum("n_bytes").alias("n_bytes"), F.max(time).alias("last"))
    return counted.select(
        "newsgroup", _bounds(F.col("w"))[0], from_micros(micros(F.col("last"))).alias("last_time"), "n_msgs", "n_bytes"
    )


def append_final(
    stream: DataFrame, make: Callable[[DataFrame], DataFrame], path: str, checkpoint: str
) -> StreamingQuery:
    """Append the windows that ``make`` counts to a table as they become final, until all there
    is now has been read. The file sink's log makes a micro-batch that ran twice count once."""
    writer = make(stream).writeStream.format("parquet").outputMode("append").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
