"""Archived files that grow micro-batch by micro-batch, exactly once.

A micro-batch writes the bytes it adds as segments into its own folder, then its manifest
(which segment is at which offset of which file), the files as they now stand, and last of
all its commit. Readers go by commits, so what a killed micro-batch left is not seen; run
again, it overwrites its own folders with the same rows. Nothing is appended in place, which
works on every store Spark can write.

    root/segments   newsgroup, dest, version, chunk_no, n_files, n_bytes, content
    root/manifest   newsgroup, dest, version, chunk_no, at, n_bytes, n_files
    root/files      newsgroup, dest, version, n_bytes, n_files, since   (all files after it)
    root/commits    n_files, n_bytes added

A file is a run of segments of one version. By default the version is the batch: a batch
that goes on in a later micro-batch goes on in its files, a later batch starts them anew.
With one message a file the version is the message; without overwriting a file has one
version for ever.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.operators.payloads import CHUNK_BYTES, archive_chunks, archive_rows
from tidewire.plans import scan
from tidewire.sinks.raw import Draft, open_root, put, qualified
from tidewire.streaming.epochs import EpochTable

SEGMENTS = "newsgroup string, dest string, version bigint, chunk_no bigint, n_files bigint, n_bytes bigint, content binary"
MANIFEST = "newsgroup string, dest string, version bigint, chunk_no bigint, at bigint, n_bytes bigint, n_files bigint"
FILES = "newsgroup string, dest string, version bigint, n_bytes bigint, n_files bigint, since bigint"
COMMITS = "n_files bigint, n_bytes bigint"
_DEST = ["newsgroup", "dest"]


class ArchiveLog:
    """The files of an archive, as far as they are committed."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        max_messages: int = 0,
        overwrite: bool = True,
        chunk_bytes: int = CHUNK_BYTES,
        block_size: int = scan.BLOCK,
    ):
        self.spark, self.max_messages, self.overwrite = spark, max_messages, overwrite
        self.chunk_bytes, self.block_size = chunk_bytes, block_size
        self.segments = EpochTable(spark, f"{root}/segments", SEGMENTS)
        self.manifest = EpochTable(spark, f"{root}/manifest", MANIFEST)
        self.files = EpochTable(spark, f"{root}/files", FILES)
        self.commits = EpochTable(spark, f"{root}/commits", COMMITS)

    def append(self, files: DataFrame, epoch: int) -> None:
        """Add the files of a micro-batch (``newsgroup, dest, article_number, part_no, batch_id,
        content``) and commit it.

        Which rows stay and where they go is decided on metadata; contents are joined once. Micro-batches
        are numbered without holes, as a streaming query numbers them."""
        self.write(files, epoch)
        self.commit(epoch)

    def write(self, files: DataFrame, epoch: int) -> None:
        """All of a micro-batch but its commit."""
        known = self.files.read(epoch - 1)
        keys = ["newsgroup", "article_number", "part_no"]
        rows = archive_rows(files.drop("content"), self.max_messages, self.overwrite, None)
        version = F.col("batch_id") if self.max_messages != 1 and self.overwrite else F.col("article_number")
        held = known.select(*_DEST, F.col("version").alias("old"), F.col("n_bytes").alias("old_bytes"))
        placed = rows.withColumn("version", version.cast("bigint")).join(held, _DEST, "left")
        # an earlier batch does not come back; a file that must not be overwritten stays as it is
        stays = F.col("old").isNull() | (F.col("version") >= F.col("old") if self.overwrite else F.lit(False))
        placed = placed.filter(stays).select(*_DEST, *keys[1:], "version")
        contents = placed.select("dest", *keys).join(files.select(*keys, "content"), keys)
        chunks = archive_chunks(contents, self.chunk_bytes, self.block_size)
        of = placed.groupBy(*_DEST).agg(F.max("version").alias("version"))
        sized = chunks.join(of, _DEST).withColumn("n_bytes", F.octet_length("content").cast("bigint"))
        stored = self.segments.write(sized.select(*_DEST, "version", "chunk_no", "n_files", "n_bytes", "content"), epoch)

        # a row per chunk of this micro-batch; the files before it are joined to know where they begin
        before = Window.partitionBy(*_DEST).orderBy("chunk_no").rowsBetween(Window.unboundedPreceding, -1)
        new = stored.drop("content").withColumn("__before", F.coalesce(F.sum("n_bytes").over(before), F.lit(0)))
        goes_on = (F.col("old") == F.col("version")) & F.lit(self.max_messages != 1)
        start = F.when(goes_on, F.col("old_bytes")).otherwise(0)
        manifest = self.manifest.write(
            new.join(held, _DEST, "left").select(*_DEST, "version", "chunk_no", (start + F.col("__before")).alias("at"), "n_bytes", "n_files"),
            epoch,
        )
        added = manifest.groupBy(*_DEST, "version").agg(
            F.max(F.col("at") + F.col("n_bytes")).alias("n_bytes"), F.sum("n_files").alias("n_files"), F.min("at").alias("__at")
        )
        was = known.select(*_DEST, F.col("version").alias("old"), F.col("n_files").alias("old_files"), F.col("since").alias("old_since"))
        grown = added.join(was, _DEST, "left").withColumn("__on", F.col("__at") > 0)
        fresh = grown.select(
            *_DEST, "version", "n_bytes",
            F.when(F.col("__on"), F.col("n_files") + F.col("old_files")).otherwise(F.col("n_files")).alias("n_files"),
            F.when(F.col("__on"), F.col("old_since")).otherwise(F.lit(epoch)).cast("bigint").alias("since"),
        )
        quiet = known.join(fresh.select(*_DEST), _DEST, "left_anti")
        self.files.write(quiet.unionByName(fresh), epoch)

    def commit(self, epoch: int) -> None:
        added = self.manifest.read(epoch).agg(F.coalesce(F.sum("n_files"), F.lit(0)).alias("n_files"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes"))
        self.commits.write(added, epoch)

    def last(self) -> int:
        """The newest committed micro-batch; -1 before the first."""
        if not self.commits.exists():
            return -1
        return self.commits.all().agg(F.coalesce(F.max("epoch"), F.lit(-1))).first()[0]

    def listing(self) -> DataFrame:
        """A row per file: ``newsgroup, dest, version, n_bytes, n_files, since``."""
        return self.files.read(self.last())

    def chunks(self, wanted: DataFrame | None = None) -> DataFrame:
        """The committed bytes of files: ``newsgroup, dest, version, at, n_bytes, content``.

        ``wanted`` (``newsgroup, dest, version, have``) leaves out what lies before the byte
        ``have`` of a file; only micro-batches that have some of the rest are read."""
        last = self.last()
        if last < 0:
            return self.spark.createDataFrame([], "newsgroup string, dest string, version bigint, at bigint, n_bytes bigint, content binary")
        listed = self.files.read(last).select(*_DEST, "version", "since")
        if wanted is not None:
            listed = listed.join(wanted.select(*_DEST, "version", "have"), [*_DEST, "version"])
        have = F.col("have") if wanted is not None else F.lit(0)
        places = self.manifest.all().filter(F.col("epoch") <= last).join(listed, [*_DEST, "version"])
        # a version that was dropped and came again under its number begins anew
        places = places.filter((F.col("epoch") >= F.col("since")) & (F.col("at") + F.col("n_bytes") > have))
        places = places.select(*_DEST, "version", "chunk_no", "epoch", "at")
        epochs = [r["epoch"] for r in places.select("epoch").distinct().collect()]  # one number per micro-batch
        return self.segments.some(epochs).join(places, [*_DEST, "version", "chunk_no", "epoch"]).select(*_DEST, "version", "at", "n_bytes", "content")

    def publish(self, root: str) -> DataFrame:
        """Bring plain files below ``root/<newsgroup>`` up to the last commit; a row per file that
        changed: ``dest, n_bytes``, the bytes it has now. Starts a job and is lazy after that.

        What is in a published file is always a beginning of its committed bytes, so its length
        says where to go on, also after a publication that was killed. Beside each file a hidden
        one names its version; a file of another version is written anew under a draft's name."""
        root = qualified(self.spark, root)

        def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, base = open_root(root)
            for frame in frames:
                paths = [f"{base}/{g}/{d}" for g, d in zip(frame["newsgroup"], frame["dest"])]
                have = [_length(fs, p) if _version(fs, p) == v else -1 for p, v in zip(paths, frame["version"])]
                yield frame.assign(have=pd.array(have, dtype="int64"))

        def extend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            fs, base = open_root(root)
            now, out = None, None
            for frame in frames:
                done = []
                for group, dest, version, at, have, content in zip(*(frame[c] for c in ("newsgroup", "dest", "version", "at", "have", "content"))):
                    if (group, dest) != now:
                        if out:
                            done.append((f"{now[0]}/{now[1]}", out.close()))
                        now, out = (group, dest), _Growing(fs, f"{base}/{group}/{dest}", version, have)
                    out.add(content[max(0, have - at) :])
                yield pd.DataFrame(done, columns=["dest", "n_bytes"]).astype({"n_bytes": "int64"})
            if out:
                yield pd.DataFrame([(f"{now[0]}/{now[1]}", out.close())], columns=["dest", "n_bytes"])

        listed = self.listing().select(*_DEST, "version", "n_bytes")
        looked = listed.mapInPandas(look, "newsgroup string, dest string, version bigint, n_bytes bigint, have bigint")
        stale = looked.filter("have < n_bytes").drop("n_bytes")
        dealt = self.chunks(stale).join(stale, [*_DEST, "version"]).repartition(*_DEST).sortWithinPartitions(*_DEST, "at")
        return dealt.mapInPandas(extend, "dest string, n_bytes bigint")


def _mark(path: str) -> str:
    folder, name = posixpath.split(path)
    return f"{folder}/.{name}.version"


def _version(fs: pyarrow.fs.FileSystem, path: str) -> int | None:
    if fs.get_file_info(_mark(path)).type != pyarrow.fs.FileType.File:
        return None
    with fs.open_input_stream(_mark(path)) as mark:
        return int(mark.read())


def _length(fs: pyarrow.fs.FileSystem, path: str) -> int:
    info = fs.get_file_info(path)
    return info.size if info.type == pyarrow.fs.FileType.File else -1


class _Growing:
    """A published file that goes on at its end, or (have < 0) is written anew."""

    def __init__(self, fs: pyarrow.fs.FileSystem, path: str, version: int, have: int):
        self.fs, self.path, self.version, self.have = fs, path, version, have
        self.draft = Draft(fs, path) if have < 0 else None
        self.out = None if self.draft else fs.open_append_stream(path)

    def add(self, content: bytes) -> None:
        if self.draft:
            self.draft.add(content)
        else:
            self.out.write(content)
            self.have += len(content)

    def close(self) -> int:
        if not self.draft:
            self.out.close()
            return self.have
        # no mark while the new file replaces the old one: killed in between, it is written anew
        if self.fs.get_file_info(_mark(self.path)).type == pyarrow.fs.FileType.File:
            self.fs.delete_file(_mark(self.path))
        self.draft.close()
        put(self.fs, _mark(self.path), str(self.version).encode())
        return self.draft.n_bytes
