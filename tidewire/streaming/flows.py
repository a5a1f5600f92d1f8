"""Following logs and relaying feeds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewire.operators.merge import tail_logs
from tidewire.operators.relay import relay
from tidewire.operators.select import log_level, log_name_filter
from tidewire.sources.spool import transport_part
from tidewire.streaming.epochs import EpochTable

LOGS = (
    "path string, record_no bigint, asctime timestamp_ntz, levelname string, name string, message string, "
    "exc_info string, stderr string, threadName string"
)


class StreamLogs:
    """New log records, filtered by name and level, merged by time per micro-batch; with a
    limit, the newest so many of each (a viewer's buffer)."""

    def __init__(self, spark: SparkSession, root: str, patterns: Sequence[str] = ("**",), level: str = "notset", limit: int | None = None):
        self.patterns, self.level, self.limit = patterns, level, limit
        self.merged = EpochTable(spark, f"{root}/logs", LOGS)

    def apply(self, batch: DataFrame, epoch: int) -> None:
        kept = log_level(log_name_filter(batch, self.patterns), self.level)
        order = ["asctime", "path", "record_no"]
        self.merged.write(kept.orderBy(*order) if self.limit is None else tail_logs(kept, self.limit, order), epoch)


def stream_relay(stream: DataFrame, target: str, path: str, checkpoint: str, valid: Column | None = None) -> StreamingQuery:
    """Relay each new valid message to a message table. The file sink's log makes a micro-batch
    that failed and runs again count once."""
    chosen = stream if valid is None else stream.filter(valid)
    writer = relay(chosen, target).writeStream.format("parquet").partitionBy("newsgroup").option("path", path)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def good_messages(messages: DataFrame) -> DataFrame:
    """Messages whose transport headers can be read; see dead_letter for the others."""
    return messages.filter(transport_part(F.col("headers"))["error"].isNull())
