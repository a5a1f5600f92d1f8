"""Watched folders and new data files."""

from __future__ import annotations

import os
import posixpath
import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.globs import glob
from tidewire.plans.storage import stage
from tidewire.sinks.raw import arrow_opens, place_of, qualified

#: A task opens so many files, or fewer where they are large.
FILES_PER_TASK = 1000
TASK_BYTES = 32 << 20
_BATCH_ROWS, _BATCH_BYTES = 10_000, 16 << 20
_LISTED = "filename string, modified bigint, n_bytes bigint"
_LISTED_ARROW = pa.schema([("filename", pa.string()), ("modified", pa.int64()), ("n_bytes", pa.int64())])
_OPENED_ARROW = _LISTED_ARROW.append(pa.field("content", pa.binary()))


def watch_files(spark: SparkSession, root: str, globs: Sequence[str], watch: str = "watch") -> DataFrame:
    """Files directly in a folder whose name matches one of the globs, each once. Empty files,
    and names that Spark's readers skip, are passed over.

    A task lists the folder into the shared folder when this is called, others open a thousand
    files each; the driver knows their number only. A root that is no folder, or a pattern of
    several, and a store that only Spark reads, go by Spark's own files."""
    pattern = globs[0] if len(globs) == 1 else "{" + ",".join(globs) + "}"
    folder = _folder(spark, root)
    if folder:
        files = _open_files(_list_folder(spark, folder, pattern), folder)
    else:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    return files.select(
        F.lit(watch).alias("watch"),
        "path",
        F.element_at(F.split("path", "/"), -1).alias("filename"),
        F.col("modificationTime").cast("timestamp_ntz").alias("modified"),
        F.col("length").alias("n_bytes"),
        "content",
    )


def _folder(spark: SparkSession, root: str) -> str | None:
    """The folder as Spark's readers name it; None if tasks can't list it by themselves."""
    place = qualified(spark, root)
    if place.startswith(("/", "file:")):
        place = "file:" + posixpath.normpath("/" + place.removeprefix("file:").lstrip("/"))
    if any(c in root for c in "{}[]*?\\") or not arrow_opens(spark, place):
        return None
    fs, base = place_of(place)
    return place.rstrip("/") if fs.get_file_info(base).type == pa.fs.FileType.Directory else None


def _entries(fs: pa.fs.FileSystem, base: str) -> Iterator[tuple[str, int, int]]:
    """Name, change time in microseconds (of whole milliseconds, as Spark gives it) and length
    of the files in a folder; those of a local folder one at a time."""
    if not isinstance(fs, pa.fs.LocalFileSystem):
        for info in fs.get_file_info(pa.fs.FileSelector(base)):
            if info.type == pa.fs.FileType.File:
                yield info.base_name, (info.mtime_ns or 0) // 1_000_000 * 1000, info.size
        return
    with os.scandir(base) as entries:
        for entry in entries:
            try:
                if entry.is_file():
                    stat = entry.stat()
                    yield entry.name, stat.st_mtime_ns // 1_000_000 * 1000, stat.st_size
            except FileNotFoundError:  # gone since it was listed
                continue


def _skipped(name: str) -> bool:
    """Names that Spark's readers take for drafts and notes of their own."""
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _list_folder(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """``filename, modified, n_bytes`` of the files, listed by one task."""
    # the same globs as in Spark's own files
    matches = spark._jvm.org.apache.hadoop.fs.GlobPattern(pattern).compiled().pattern()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = re.compile(matches, re.DOTALL | re.ASCII).fullmatch
        for _ in batches:
            rows = []
            for name, modified, n_bytes in _entries(*place_of(folder)):
                if n_bytes and test(name) and not _skipped(name):
                    rows.append((name, modified, n_bytes))
                if len(rows) >= _BATCH_ROWS:
                    yield _batch(rows, _LISTED_ARROW)
                    rows = []
            yield _batch(rows, _LISTED_ARROW)

    return stage(spark.range(0, 1, 1, 1).mapInArrow(run, _LISTED), "watched")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _open_files(listed: DataFrame, folder: str) -> DataFrame:
    """The columns of Spark's binaryFile, for listed files of a folder."""
    spark = listed.sparkSession
    missing_ok = spark.conf.get("spark.sql.files.ignoreMissingFiles") == "true"
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    tasks = max(-(-n // FILES_PER_TASK), -(-size // TASK_BYTES), spark.sparkContext.defaultParallelism)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place_of(folder)
        for batch in batches:
            rows, held = [], 0
            for name, modified, n_bytes in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    with fs.open_input_stream(f"{base}/{name}", compression=None) as file:
                        content = file.read()
                except FileNotFoundError:
                    if missing_ok:
                        continue
                    raise
                rows.append((name, modified, n_bytes, content))
                held += len(content)
                if held >= _BATCH_BYTES:
                    yield _batch(rows, _OPENED_ARROW)
                    rows, held = [], 0
            yield _batch(rows, _OPENED_ARROW)

    opened = listed.repartition(max(1, min(n, tasks))).mapInArrow(run, f"{_LISTED}, content binary")
    return opened.select(
        F.concat(F.lit(f"{folder}/"), "filename").alias("path"),
        F.timestamp_micros("modified").alias("modificationTime"),
        F.col("n_bytes").alias("length"),
        "content",
    )


def file_groups(files: DataFrame, group_files: bool, entry: Sequence[str] = ("path", "filename", "content")) -> DataFrame:
    """What becomes one message: each file, or all files of a watch in order of ``entry``, the
    columns of a file that are wanted.

    A grouped watch is one message by definition, so its files come together, in one row: where
    a digest of the contents does, take that before and name it in ``entry``."""
    entry = F.struct(*entry)
    if not group_files:
        return files.select("watch", F.array(entry).alias("files"))
    return files.groupBy("watch").agg(F.array_sort(F.collect_list(entry)).alias("files"))


def poll_new_files(
    files: DataFrame,
    mark: str,
    name: str = "*",
    include_current: bool = False,
    max_files: int | None = None,
    last_index: str | None = None,
) -> DataFrame:
    """Files (``path, modified``) changed after the mark whose name matches; the last by name
    is still being written and left out; of the rest the last ``max_files``; names not past
    the last posted one are skipped."""
    base = F.element_at(F.split("path", "/"), -1)
    found = files.filter(F.col("modified") > F.lit(mark).cast("timestamp_ntz")).filter(glob(base, name))
    if not include_current:
        found = found.filter(F.col("path") < found.agg(F.max("path")).scalar())
    if max_files:
        found = found.orderBy(F.desc("path")).limit(max_files)
    if last_index is not None:
        # the name without its last suffix
        found = found.filter(F.regexp_replace(base, r"(?<=.)\.[^.]*$", "") > F.lit(last_index))
    return found.orderBy("path")


def next_mark(processed: DataFrame) -> DataFrame:
    """The mark after a poll: the newest change time processed."""
    return processed.agg(F.max("modified").alias("mark"))
