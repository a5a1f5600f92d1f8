"""Tables with one folder per micro-batch.

A micro-batch writes only its own folder and reads the state of the one
before. Running it again after a failure overwrites the same folder, so the
tables hold each message's effect once.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery


class EpochTable:
    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self.schema = schema

    def _folder(self, epoch: int) -> str:
        return f"{self.root}/epoch={epoch}"

    def write(self, df: DataFrame, epoch: int) -> DataFrame:
        """Store this micro-batch's rows and go on from the stored ones."""
        df.write.mode("overwrite").parquet(self._folder(epoch))
        return self.read(epoch)

    def write_once(self, df: DataFrame, epoch: int) -> DataFrame:
        """Store this micro-batch's rows unless they are there, for streams that follow the table:
        the folder appears whole, by one renaming, and never changes after that. Needs a file
        system that renames folders in one step (local, HDFS)."""
        final = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(epoch))
        files = final.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not files.exists(final):
            coming = f"{self.root}/_coming-{uuid.uuid4().hex}"
            df.write.parquet(coming)
            if not files.rename(self.spark._jvm.org.apache.hadoop.fs.Path(coming), final):
                raise OSError(f"cannot rename {coming} to {final}")
        return self.read(epoch)

    def read(self, epoch: int) -> DataFrame:
        """Rows of one micro-batch; none before the first."""
        if epoch < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(self._folder(epoch))

    def exists(self) -> bool:
        """Whether any micro-batch has been stored."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def some(self, epochs: Iterable[int]) -> DataFrame:
        """Rows of some micro-batches, with their epoch."""
        schema = f"{self.schema}, epoch bigint"
        folders = [self._folder(e) for e in epochs]
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", self.root).parquet(*folders)

    def all(self) -> DataFrame:
        """Rows of all micro-batches, with their epoch."""
        return self.spark.read.schema(f"{self.schema}, epoch bigint").parquet(self.root)


class FoldedTable:
    """A table of states. A micro-batch stores the rows it touched; every ``every``-th one also
    stores the ``fold`` of all so far, so that a reader opens at most ``every`` folders more.

    ``fold(rows)`` brings several rows of a key to one; it must not matter in which groups."""

    def __init__(self, spark: SparkSession, root: str, schema: str, fold: Callable[[DataFrame], DataFrame], every: int = 16):
        self.touched = EpochTable(spark, f"{root}/touched", schema)
        self.folded = EpochTable(spark, f"{root}/folded", schema)
        self.fold, self.every = fold, every

    def parts(self, epoch: int) -> DataFrame:
        """The rows that together are the table after a micro-batch, several a key."""
        base = max(epoch, 0) // self.every * self.every
        if base == 0:
            return self.touched.some(range(epoch + 1)).drop("epoch")
        return self.folded.read(base).unionByName(self.touched.some(range(base + 1, epoch + 1)).drop("epoch"))

    def current(self, epoch: int) -> DataFrame:
        """The table after a micro-batch, one row a key; empty before the first."""
        return self.fold(self.parts(epoch))

    def add(self, rows: DataFrame, epoch: int, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
        """Store what a micro-batch touched and go on from it; of what is folded, what ``keep`` leaves."""
        touched = self.touched.write(rows, epoch)
        if epoch > 0 and epoch % self.every == 0:
            self.folded.write(keep(self.fold(self.parts(epoch - 1).unionByName(touched))), epoch)
        return touched


def run_batches(
    stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = None, once: bool = False
) -> StreamingQuery:
    """Start a query that hands each micro-batch to ``apply``: every so often, in one single
    micro-batch, or (the default) until all there is now has been read.

    A query with processing-time timeouts always has another micro-batch to run, so the
    default never ends for it; give it ``every`` or ``once``."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    if every:
        writer = writer.trigger(processingTime=every)
    elif once:
        writer = writer.trigger(once=True)
    else:
        writer = writer.trigger(availableNow=True)
    return writer.start()
