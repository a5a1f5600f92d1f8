"""Token counts of flat, unindexed token files by a separator scan.

A flat token file is nothing but ids of a fixed width, the documents one after the
other, each with an end-of-document id behind it. There is no index. A file is cut
into blocks of equal size, wherever that falls; in each block the separators are found
by one vectorised comparison. What a block cannot know alone, how many separators came
before it and how many tokens stand between the last of them and its start, comes
from a prefix scan over one summary row per block.

`write` makes such files with Spark's own text writer: a row is a document's ids and
the line separator is the end-of-document id. That holds for every storage Spark can
write to, and needs an id whose bytes are valid text. The default, big-endian 16-bit
ids with 0xC280 (49 792) as the end, is above the tokenizer's vocabulary, so no text
contains it. `manifest` gives the doc_id of each place in each file from the same
partitions; `counts` checks that files and manifest agree and raises if they don't.

Defined results: null and empty texts have 0 tokens; repeated rows are documents of
their own; tokens behind a file's last separator are one unfinished document
(`ended` false); an empty file has none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.llm.tokens import encoder, public_path
from tidewire.plans.storage import shared_path, stage

DTYPE = ">u2"
END = 0xC280
BLOCK = 1 << 18


def write(docs: DataFrame, path: str, dtype: str = DTYPE, end: int = END, tokenizer: str | None = None) -> None:
    """One flat token file per partition of docs, in the order of its rows."""
    kind = np.dtype(dtype)
    order = "little" if kind.byteorder == "<" else "big"
    separator = end.to_bytes(kind.itemsize, order).decode()  # raises for bytes that are no text
    file = tokenizer or public_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(file, dtype, special_as_text=True)
        for batch in batches:
            texts = batch.column("text")
            for at in range(0, len(texts), 64):
                yield pa.RecordBatch.from_pydict({"ids": pa.array(coder.encode(texts.slice(at, 64).to_pylist()), pa.binary())})

    coded = docs.select("text").mapInArrow(run, "ids binary")
    coded.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", separator).text(path)


def manifest(docs: DataFrame) -> DataFrame:
    """(part, place, doc_id): the file and the place in it that `write` gives each row."""
    at = F.monotonically_increasing_id()
    rows = docs.select("doc_id", at.alias("at"))
    return rows.select(F.shiftright("at", 33).alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), "doc_id")


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content")


def _cutter(block: int, dtype: str):
    size = block * np.dtype(dtype).itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                whole = content.as_buffer()
                for k, at in enumerate(range(0, whole.size, size)):
                    part = whole.slice(at, min(size, whole.size - at)).to_pybytes()
                    yield pa.RecordBatch.from_pydict({"file": [name], "block": pa.array([k], pa.int64()), "ids": pa.array([part], pa.binary())})

    return cut


def blocks(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = DTYPE) -> DataFrame:
    """(file, block, ids): the files below path, cut into blocks of `block` ids."""
    return _files(spark, path).mapInArrow(_cutter(block, dtype), "file string, block long, ids binary")


def _finder(dtype: str, end: int):

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, block, ids in zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), batch.column("ids")):
                values = np.frombuffer(ids.as_buffer(), dtype)
                ends = np.flatnonzero(values == end)
                sizes = np.diff(ends, prepend=-1) - 1
                rest = len(values) - (int(ends[-1]) + 1 if len(ends) else 0)
                yield pa.RecordBatch.from_pydict({
                    "file": [file], "block": pa.array([block], pa.int64()), "found": pa.array([len(ends)], pa.int64()),
                    "rest": pa.array([rest], pa.int64()), "sizes": pa.array([sizes], pa.list_(pa.int64())),
                })

    return run


_FOUND = "file string, block long, found long, rest long, sizes array<long>"


def scan(blocks_: DataFrame, dtype: str = DTYPE, end: int = END) -> DataFrame:
    """(file, place, n_tokens, ended) of every document in (file, block, ids)."""
    return _stitched(blocks_.mapInArrow(_finder(dtype, end), _FOUND))


def scan_files(spark: SparkSession, path: str, block: int = BLOCK, dtype: str = DTYPE, end: int = END) -> DataFrame:
    """`scan` of the `blocks` of files, both in one Python worker a task."""
    cut, find = _cutter(block, dtype), _finder(dtype, end)
    return _stitched(_files(spark, path).mapInArrow(lambda batches: find(cut(batches)), _FOUND))


def _stitched(found: DataFrame) -> DataFrame:
    seen = stage(found, "separators")
    # one row per block: separators before it, and tokens since the last of them
    before = Window.partitionBy("file").orderBy("block")
    until = before.rowsBetween(Window.unboundedPreceding, -1)
    summary = seen.select("file", "block", "found", "rest")
    run_ = F.coalesce(F.sum((F.col("found") > 0).cast("long")).over(until), F.lit(0))
    summary = summary.select("*", F.coalesce(F.sum("found").over(until), F.lit(0)).alias("place"), run_.alias("run"))
    since = Window.partitionBy("file", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    # within a run only its first block follows one with a separator, whose rest it inherits
    ended = F.coalesce(F.lag("rest").over(before), F.lit(0))
    summary = summary.withColumn("entered", F.when(F.row_number().over(Window.partitionBy("file", "run").orderBy("block")) == 1, ended).otherwise(F.lit(0)))
    inner = F.coalesce(F.sum(F.col("rest") + F.col("entered")).over(since), F.lit(0)) + F.col("entered")
    carried = stage(summary.select("file", "block", "place", inner.alias("carry"), "rest", "found"), "carried")
    stitched = seen.select("file", "block", "sizes").join(carried.select("file", "block", "place", "carry"), ["file", "block"])
    docs = stitched.select("file", "place", "carry", F.posexplode("sizes").alias("k", "size"))
    docs = docs.select("file", (F.col("place") + F.col("k")).alias("place"), F.when(F.col("k") == 0, F.col("size") + F.col("carry")).otherwise(F.col("size")).alias("n_tokens"), F.lit(True).alias("ended"))
    last = carried.groupBy("file").agg(F.max(F.struct("block", "place", "found", "rest", "carry")).alias("x"))
    open_ = F.col("x.rest") + F.when(F.col("x.found") == 0, F.col("x.carry")).otherwise(F.lit(0))
    tail = last.select("file", (F.col("x.place") + F.col("x.found")).alias("place"), open_.alias("n_tokens"), F.lit(False).alias("ended"))
    return docs.union(tail.where("n_tokens > 0"))


def counts(docs: DataFrame, tokenizer: str | None = None, block: int = BLOCK) -> DataFrame:
    """(doc_id, part, place, n_tokens): docs written as flat token files in the shared
    folder, and every document's tokens counted there. docs must be a plain scan, whose
    partitions are the same each time it is read; write other tables first."""
    spark = docs.sparkSession
    path = shared_path(spark, "tokens")
    write(docs, path, tokenizer=tokenizer)
    found = scan_files(spark, path, block)
    part = F.regexp_extract("file", r"part-(\d+)-", 1).cast("long")
    found = stage(found.select(part.alias("part"), "place", "n_tokens"), "counts")
    named = stage(manifest(docs), "manifest")
    if found.count() != named.count() or not named.join(found, ["part", "place"], "left_anti").isEmpty():
        raise RuntimeError("token files and manifest disagree: the input changed meanwhile")
    return named.join(found, ["part", "place"]).select("doc_id", "part", "place", "n_tokens")
