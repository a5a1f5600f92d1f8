"""Writing files from inside tasks, on any file system Arrow knows."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession


def put(fs: pyarrow.fs.FileSystem, path: str, content: bytes) -> None:
    """Write under a temporary name, then rename, so that a repeated task leaves one whole file."""
    draft = Draft(fs, path)
    draft.add(content)
    draft.close()


def open_root(root: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        if root.startswith("file:") and not root.startswith("file://"):
            root = "file://" + root[5:]
        return pyarrow.fs.FileSystem.from_uri(root)
    return pyarrow.fs.LocalFileSystem(), root


def place_of(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a path as Spark's readers name it, not escaped, and the path there."""
    scheme, colon, rest = path.partition(":")
    if not colon or scheme == "file":
        return pyarrow.fs.LocalFileSystem(), posixpath.join("/", rest.lstrip("/")) if colon else path
    authority, _, name = rest.removeprefix("//").partition("/")
    fs, base = open_root(f"{scheme}://{authority}/")
    return fs, f"{base.rstrip('/')}/{name}"


def arrow_opens(spark: SparkSession, root: str) -> bool:
    """Whether Arrow knows the file system of a path; others only Spark reads."""
    try:
        place_of(qualified(spark, root))
    except (pa.ArrowException, OSError):
        return False
    return True


def qualified(spark: SparkSession, root: str) -> str:
    """A path without a scheme, as Spark reads it: on the default file system."""
    if "://" in root or root.startswith("file:"):
        return root
    default = spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")
    return posixpath.abspath(root) if default.startswith("file:") else default.rstrip("/") + root


class Draft:
    """A file that is written piece by piece and appears, whole, when it is closed."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str):
        folder, name = posixpath.split(path)
        self.fs, self.path, self.n_bytes = fs, path, 0
        self.draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
        try:
            self.out = fs.open_output_stream(self.draft)
        except FileNotFoundError:  # the first file of its folder
            fs.create_dir(folder, recursive=True)
            self.out = fs.open_output_stream(self.draft)

    def add(self, content: bytes) -> None:
        self.out.write(content)
        self.n_bytes += len(content)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.draft, self.path)


def write_files(files: DataFrame, root: str) -> DataFrame:
    """Store ``content`` of each row at ``root/dest``; a row per file written. Lazy: the files
    are written when the result is.

    Rows with a ``chunk_no`` are pieces of a file: those of one ``dest`` go into it in this
    order, by one task that holds one piece at a time."""
    root = qualified(files.sparkSession, root)

    def join(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_root(root)
        now, draft = None, None
        for frame in frames:
            done = []
            for dest, content in zip(frame["dest"], frame["content"]):
                if dest != now:
                    if draft:
                        draft.close()
                        done.append((now, draft.n_bytes))
                    now, draft = dest, Draft(fs, f"{base}/{dest}")
                draft.add(content)
            yield pd.DataFrame(done, columns=["dest", "n_bytes"]).astype({"n_bytes": "int64"})
        if draft:
            draft.close()
            yield pd.DataFrame([(now, draft.n_bytes)], columns=["dest", "n_bytes"])

    if "chunk_no" in files.columns:
        dealt = files.select("dest", "chunk_no", "content").repartition("dest").sortWithinPartitions("dest", "chunk_no")
        return dealt.select("dest", "content").mapInPandas(join, "dest string, n_bytes bigint")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_root(root)
        for frame in frames:
            for dest, content in zip(frame["dest"], frame["content"]):
                put(fs, f"{base}/{dest}", content)
            yield pd.DataFrame({"dest": frame["dest"], "n_bytes": frame["content"].map(len).astype("int64")})

    return files.select("dest", "content").mapInPandas(run, "dest string, n_bytes bigint")
