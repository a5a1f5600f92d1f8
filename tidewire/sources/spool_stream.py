"""A spool that grows, as a streaming source with one mark per feed."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyarrow.fs import FileSelector, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewire.schema import MESSAGES
from tidewire.sinks.raw import open_root, qualified
from tidewire.sources.spool import parse_article

ARTICLES_PER_TASK = 1000
BATCH_BYTES = 16 << 20
_HIGHEST = (1 << 63) - 1


@lru_cache(maxsize=16)
def _opened(root: str):
    fs, base = open_root(root)
    return fs, base.rstrip("/")


class ArticleRange(InputPartition):
    """Articles of one feed from one number to another, as the names of their files."""

    def __init__(self, folder: str, names: list[str]):
        self.folder, self.names = folder, names


class Spool:
    """The folders and articles below a root. A feed is known by its folder; marks are
    ``{folder: highest article number seen}``."""

    def __init__(self, root: str):
        self.root = root

    def _base(self):
        return _opened(self.root)

    def articles(self, folder: str) -> tuple[list[tuple[int, str]], list[str]]:
        """``(number, file name)`` of the articles in a folder, by number, and its subfolders.
        Names that Spark's readers skip are skipped here too."""
        fs, base = self._base()
        found, below = [], []
        # a feed may be gone since it was listed; a root that is not there is an error
        for info in fs.get_file_info(FileSelector(f"{base}/{folder}" if folder else base, allow_not_found=bool(folder))):
            name = info.base_name
            if info.type == FileType.Directory:
                if not name.startswith(("_", ".")):
                    below.append(f"{folder}/{name}" if folder else name)
            elif re.fullmatch("[0-9]+", name) and int(name) <= _HIGHEST:
                found.append((int(name), name))
        return sorted(found), below

    def marks(self) -> dict[str, int]:
        """The highest number of every feed that has articles; one folder in memory at a time."""
        highest, folders = {}, [""]
        while folders:
            folder = folders.pop()
            found, below = self.articles(folder)
            folders += below
            if found:
                highest[folder] = found[-1][0]
        return highest

    def ranges(self, start: dict[str, int], end: dict[str, int], per_task: int) -> list[ArticleRange]:
        """Articles after ``start`` up to ``end``, cut into ranges of bounded count. A mark
        above what its feed has was made before the feed was renumbered: it starts over."""
        out = []
        for folder, high in sorted(end.items()):
            mark = start.get(folder, -1)
            if mark == high:
                continue
            if mark > high:
                mark = -1
            names = [name for number, name in self.articles(folder)[0] if mark < number <= high]
            out += [ArticleRange(folder, names[i : i + per_task]) for i in range(0, len(names), per_task)]
        return out

    def fetch(self, folder: str, name: str) -> bytes | None:
        """An article's bytes; None if it expired since it was listed."""
        fs, base = self._base()
        try:
            with fs.open_input_stream(f"{base}/{folder}/{name}" if folder else f"{base}/{name}", compression=None) as file:
                return file.read()
        except FileNotFoundError:
            return None

    def read(self, part: ArticleRange) -> Iterator[pa.RecordBatch]:
        """Messages of a range, in Arrow batches of bounded size."""
        schema = to_arrow_schema(MESSAGES)
        place = re.sub("^file:/*", "file:/", self.root.rstrip("/")) if self.root.startswith("file:") else self.root.rstrip("/")
        place = f"file:{place}" if place.startswith("/") else place
        rows, size = [], 0
        for name in part.names:
            raw = self.fetch(part.folder, name)
            if raw is None:
                continue
            row = parse_article(raw, int(name))
            row |= {"newsgroup": part.folder.replace("/", "."), "article_number": int(name), "n_bytes": len(raw)}
            row |= {"path": "/".join(x for x in (place, part.folder, name) if x), "headers": list(row["headers"].items())}
            rows.append(row)
            size += len(raw)
            if size >= BATCH_BYTES:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=schema)


class SpoolReader(DataSourceReader):
    def __init__(self, spool: Spool, marks: dict[str, int], per_task: int):
        self.spool, self.marks, self.per_task = spool, marks, per_task

    def partitions(self) -> list[ArticleRange]:
        return self.spool.ranges(self.marks, self.spool.marks(), self.per_task)

    def read(self, partition: ArticleRange) -> Iterator[pa.RecordBatch]:
        return self.spool.read(partition) if partition else iter(())


class SpoolStreamReader(DataSourceStreamReader):
    def __init__(self, spool: Spool, marks: dict[str, int], per_task: int):
        self.spool, self.start, self.per_task = spool, marks, per_task

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        return self.spool.marks()

    def partitions(self, start: dict, end: dict) -> list[ArticleRange]:
        return self.spool.ranges(start, end, self.per_task)

    def read(self, partition: ArticleRange) -> Iterator[pa.RecordBatch]:
        return self.spool.read(partition)


class SpoolSource(DataSource):
    """Format ``tidewire_spool``: messages of the spool at ``path``, those after ``marks`` (a JSON
    object) where given, ``articlesPerTask`` to a task."""

    @classmethod
    def name(cls) -> str:
        return "tidewire_spool"

    def schema(self) -> StructType:
        return MESSAGES

    def _arguments(self) -> tuple[Spool, dict[str, int], int]:
        marks = {feed.replace(".", "/"): n for feed, n in json.loads(self.options.get("marks", "{}")).items()}
        return Spool(self.options["path"]), marks, int(self.options.get("articlesPerTask", ARTICLES_PER_TASK))

    def reader(self, schema: StructType) -> SpoolReader:
        return SpoolReader(*self._arguments())

    def streamReader(self, schema: StructType) -> SpoolStreamReader:
        return SpoolStreamReader(*self._arguments())


def _source(reader, spark: SparkSession, root: str, marks: dict[str, int] | None, articles_per_task: int) -> DataFrame:
    spark.dataSource.register(SpoolSource)
    options = {"marks": json.dumps(marks or {}), "articlesPerTask": str(articles_per_task)}
    return reader.format(SpoolSource.name()).options(**options).load(qualified(spark, root))


def stream_spool(spark: SparkSession, root: str, marks: dict[str, int] | None = None, articles_per_task: int = ARTICLES_PER_TASK) -> DataFrame:
    """New articles of a spool as they come. The offset is the highest number of each feed, so
    a poll lists names and opens new articles only.

    Numbers grow within a feed: one that appears later below the mark counts as read. A feed
    whose highest number fell below its mark was renumbered and is read from its start; a feed
    renumbered past its mark before the next poll can't be told from one that went on. Rows
    are those of read_spool, and an empty file, which that passes over, is a message too."""
    return _source(spark.readStream, spark, root, marks, articles_per_task)


def unread_spool(spark: SparkSession, root: str, marks: dict[str, int], articles_per_task: int = ARTICLES_PER_TASK) -> DataFrame:
    """The articles past each feed's own mark, once; feeds without a mark whole."""
    return _source(spark.read, spark, root, marks, articles_per_task)
