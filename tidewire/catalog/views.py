"""The given tables seen as message feeds.

Each view is a projection: no window, no shuffle. Article numbers come from
the event or document number, so they grow within a feed and have holes, as a
feed has after cancelled articles.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

EPOCH_2024 = 1704067200000000
_K = "CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)"

FEED = [
    "concat('transport.demo.', event_type) AS newsgroup",
    "event_id + 1 AS article_number",
    "event_id",
    "ts AS msg_time",
    "concat('site', CAST(user_id % 4 AS STRING)) AS site",
    "user_id",
    "value",
    "props",
    "CAST(length(props) AS BIGINT) AS n_bytes",
]
# Arrival delayed by up to 99 places: message times go back and forth.
LATE_FEED = ["(event_id + k) * 100 + k AS article_number" if c.startswith("event_id +") else c for c in FEED]
FILES = [
    "concat('transport.docs.', source) AS newsgroup",
    "doc_id + 1 AS article_number",
    "concat('doc-', CAST(doc_id AS STRING), '.', lang, '.txt') AS filename",
    "doc_id",
    "text AS content_text",
    "lang",
]
OBSERVATIONS = [
    "user_id AS member",
    "event_id AS seq",
    "ts",
    "CASE WHEN event_type = 'error' THEN 'offline' ELSE 'online' END AS state",
]
USAGE = [
    "concat('/data/d', CAST(event_id % 5 AS STRING)) AS mount",
    "event_id AS seq",
    "CAST(floor(event_id / 5) AS BIGINT) AS snapshot",
    "ts",
    "value % 100 AS usedpct",
    "(user_id + 1) * 1000000007 AS totalbytes",
]
COUNTERS = [
    "concat('eth', CAST(user_id % 3 AS STRING)) AS device",
    "event_id AS seq",
    "ts",
    "(event_id * 50000000 + CAST(floor(value * 100000) AS BIGINT)) % 4294967296 AS rx_bytes",
]
SAMPLES = [
    "concat('site', CAST(user_id % 4 AS STRING)) AS plotgroup",
    "event_type AS variable",
    "event_id AS seq",
    "ts",
    "value",
]


def _sql(columns: list[str], source: str) -> str:
    return f"SELECT {', '.join(columns)} FROM {source}"


SQL_VIEWS = {
    "feed": _sql(FEED, "events"),
    "late_feed": _sql(LATE_FEED, f"(SELECT *, {_K} AS k FROM events)"),
    "files": _sql([*FILES, f"make_timestamp({EPOCH_2024} + doc_id * 420000000) AS msg_time",
                   "CAST(octet_length(encode(text)) AS BIGINT) AS n_bytes"], "documents"),
    "observations": _sql(OBSERVATIONS, "events"),
    "usage": _sql(USAGE, "events"),
    "counters": _sql(COUNTERS, "events"),
    "samples": _sql(SAMPLES, "events"),
}


class Tables:
    """Lazily opened tables and views of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events")

    @cached_property
    def documents(self) -> DataFrame:
        return self.table("documents")

    @cached_property
    def pages(self) -> DataFrame:
        return self.table("pages")

    @cached_property
    def feed(self) -> DataFrame:
        return self.events.selectExpr(*FEED)

    @cached_property
    def late_feed(self) -> DataFrame:
        return self.events.selectExpr("*", f"{_K} AS k").selectExpr(*LATE_FEED)

    @cached_property
    def files(self) -> DataFrame:
        return self.documents.selectExpr(
            *FILES,
            f"CAST(timestamp_micros({EPOCH_2024} + doc_id * 420000000) AS TIMESTAMP_NTZ) AS msg_time",
            "CAST(octet_length(text) AS BIGINT) AS n_bytes",
        )

    @cached_property
    def observations(self) -> DataFrame:
        return self.events.selectExpr(*OBSERVATIONS)

    @cached_property
    def usage(self) -> DataFrame:
        return self.events.selectExpr(*USAGE)

    @cached_property
    def counters(self) -> DataFrame:
        return self.events.selectExpr(*COUNTERS)

    @cached_property
    def samples(self) -> DataFrame:
        return self.events.selectExpr(*SAMPLES)
