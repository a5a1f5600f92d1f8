"""Change detection from run to run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.plans import scan
from tidewire.streaming.epochs import EpochTable, FoldedTable


class StreamChanges:
    """Checks whose digest differs from the check of the same page before, while checks come in.

    ``digests(batch)`` makes one row ``key, order, digest`` (and more, all narrow) of each check;
    it runs once a micro-batch. A run reads the new checks and the last digest of each page.
    Checks of a page are numbered upwards and come whole: one at or below the page's highest
    number was seen before and is left out. ``changes`` has the changed checks."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: str,
        digests: Callable[[DataFrame], DataFrame],
        key: str = "page",
        order: str = "check_no",
        block_size: int = scan.BLOCK,
        every: int = 16,
    ):
        self.digests, self.key, self.order, self.block_size = digests, key, order, block_size
        self.checks = EpochTable(spark, f"{root}/checks", schema)
        self.changes = EpochTable(spark, f"{root}/changes", schema)
        types = {f.name: f.dataType.simpleString() for f in self.checks.read(-1).schema}
        state = f"`{key}` {types[key]}, last_no {types[order]}, last_digest string"
        self.last = FoldedTable(spark, f"{root}/last", state, self._newest, every)

    def _newest(self, states: DataFrame) -> DataFrame:
        return states.groupBy(self.key).agg(F.max("last_no").alias("last_no"), F.max_by("last_digest", "last_no").alias("last_digest"))

    def apply(self, batch: DataFrame, epoch: int) -> None:
        columns = self.checks.read(-1).columns
        checks = self.checks.write(self.digests(batch).select(*columns), epoch)
        last = self.last.current(epoch - 1).withColumnRenamed(self.key, "__page")
        seen = checks.join(last, F.col(self.key).eqNullSafe(F.col("__page")), "left").drop("__page")
        fresh = seen.filter(F.col("last_no").isNull() | (F.col(self.order) > F.col("last_no")))
        linked = scan.running(fresh, [self.key], self.order, {"__before": scan.previous("digest")}, self.block_size)
        # the first new check of a page is compared with the last one of the runs before
        first = F.col("__before").isNull()
        same = F.when(first, F.col("last_no").isNotNull() & F.col("digest").eqNullSafe(F.col("last_digest")))
        same = same.otherwise(F.col("digest").eqNullSafe(F.col("__before")["digest"]))
        self.changes.write(linked.filter(~same).select(*columns), epoch)
        newest = fresh.groupBy(self.key).agg(F.max(self.order).alias("last_no"), F.max_by("digest", self.order).alias("last_digest"))
        self.last.add(newest, epoch)
