"""A stored message table that knows what is in each of its files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.times import duration_micros
from tidewire.operators.marks import effective_marks
from tidewire.operators.select import recent, recent_to_newest
from tidewire.plans.storage import stage
from tidewire.streaming.epochs import EpochTable

ROWS_PER_FILE = 1 << 20
INDEX = "file string, newsgroup string, low bigint, high bigint, first_time timestamp_ntz, last_time timestamp_ntz, n bigint"


class MessageTable:
    """Messages in files of one feed each, sorted by article number, and an index with a row per
    file: its feed, lowest and highest article and time. Readers choose files by the index, so
    that every feed's own mark or time decides what is opened.

    ``schema`` has ``newsgroup, article_number, msg_time`` and what else the messages have. Messages
    are appended in numbered batches; a batch is there when its index is, and one that is
    written again replaces itself. Paths of the chosen files go through the driver, as they do
    in Spark's own listing of a folder."""

    def __init__(self, spark: SparkSession, root: str, schema: str, rows_per_file: int = ROWS_PER_FILE):
        self.spark, self.root, self.rows_per_file = spark, root.rstrip("/"), rows_per_file
        self.empty = spark.createDataFrame([], schema)
        self.stored = EpochTable(spark, f"{self.root}/index", INDEX)

    def append(self, messages: DataFrame, batch: int) -> None:
        """Store a batch. Ranges of (feed, article) go to the tasks, so a hot feed is many files."""
        folder = f"{self.root}/data/batch={batch}"
        dealt = messages.select(*self.empty.columns).repartitionByRange("newsgroup", "article_number")
        placed = dealt.sortWithinPartitions("newsgroup", "article_number")
        placed.write.mode("overwrite").option("maxRecordsPerFile", self.rows_per_file).partitionBy("newsgroup").parquet(folder)
        # paths come encoded, except for the plus sign
        path = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        rows = self.spark.read.schema(self.empty.schema).parquet(folder)
        rows = rows.select(F.substring_index(path, "/data/", -1).alias("file"), "newsgroup", "article_number", "msg_time")
        index = rows.groupBy("file", "newsgroup").agg(
            F.min("article_number").alias("low"), F.max("article_number").alias("high"),
            F.min("msg_time").alias("first_time"), F.max("msg_time").alias("last_time"), F.count("*").alias("n"),
        )
        self.stored.write(index, batch)

    def index(self) -> DataFrame:
        """The files of all batches that are whole."""
        return self.stored.all().drop("epoch") if self.stored.exists() else self.spark.createDataFrame([], INDEX)

    def feeds(self) -> DataFrame:
        """Low and high article of each feed, their distance and the messages there are, from the index alone."""
        marks = self.index().groupBy("newsgroup").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n_messages"))
        return marks.withColumn("n_articles", F.col("high") - F.col("low") + 1)

    def messages(self, files: DataFrame | None = None) -> DataFrame:
        """The messages of some files (``file``), or of all."""
        chosen = (self.index() if files is None else files).select("file").collect()
        if not chosen:
            return self.empty
        reader = self.spark.read.schema(self.empty.schema).option("basePath", f"{self.root}/data")
        return reader.parquet(*(f"{self.root}/data/{r.file}" for r in chosen)).select(*self.empty.columns)

    def unread(self, marks: DataFrame) -> DataFrame:
        """Messages past each feed's mark. Files that end at or before their feed's mark are not
        opened, however far behind another feed is. Starts a job when called."""
        starts = stage(effective_marks(self.feeds(), marks).select("newsgroup", "mark"), "marks")
        wanted = stage(self.index().join(starts, "newsgroup").filter(F.col("high") > F.col("mark")), "wanted")
        oldest = wanted.agg(F.min("mark")).first()[0]
        rows = self.messages(wanted)
        new = rows if oldest is None else rows.filter(F.col("article_number") > oldest)
        return new.join(starts, "newsgroup").filter(F.col("article_number") > F.col("mark")).drop("mark")

    def recent(self, offset: str | float, now: str) -> DataFrame:
        """Messages of the last ``offset`` before ``now``; only files that reach into it."""
        back = F.expr(f"INTERVAL {duration_micros(offset)} MICROSECOND")
        late = F.col("last_time") >= F.lit(now).cast("timestamp_ntz") - back
        return recent(self.messages(self.index().filter(late)), offset, now)

    def recent_to_newest(self, offset: str | float) -> DataFrame:
        """The same per feed, counted back from its newest message, which the index knows."""
        index = self.index()
        newest = index.groupBy("newsgroup").agg(F.max("last_time").alias("newest"))
        back = F.expr(f"INTERVAL {duration_micros(offset)} MICROSECOND")
        late = index.join(newest, "newsgroup").filter(F.col("last_time") >= F.col("newest") - back)
        return recent_to_newest(self.messages(late), offset)
