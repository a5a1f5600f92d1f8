"""Files and their contents: splitting, joining, compressing, archiving.

What to do with a file is decided on metadata; contents are joined back once.
"""

from __future__ import annotations

import bz2
import gzip
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.content import checksum
from tidewire.functions.sizes import bytes_value
from tidewire.plans import scan
from tidewire.plans.storage import stage
from tidewire.sinks.raw import write_files

OK, MISMATCH, UNCHECKED, INCOMPLETE = "ok", "mismatch", "no checksum", "incomplete"
CHUNK_BYTES = 64 << 20
#: What a task makes before it hands it on.
SLICE_BYTES = 4 << 20
FILE = ["newsgroup", "original"]


# ---------------------------------------------------------- split and join


def split_files(files: DataFrame, max_size: str | int = "20Mb") -> DataFrame:
    """Cut contents larger than ``max_size``; other files stay one part under their own name.

    Adds part_no (from 0), n_parts, original (null when not split) and the checksum of the
    whole. The chunks are built as one array and exploded without the content they came from."""
    limit = bytes_value(max_size) if isinstance(max_size, str) else max_size
    size = F.octet_length("content")
    n_parts = F.greatest(F.lit(1), F.ceil(size / F.lit(limit))).cast("int")
    chunks = F.transform(
        F.sequence(F.lit(0), n_parts - 1),
        lambda k: F.substring(F.col("content"), k * F.lit(limit) + 1, F.lit(limit)),
    )
    kept = [c for c in files.columns if c not in ("content", "filename")]
    parts = files.select(
        *kept, "filename", checksum(F.col("content")).alias("checksum"), n_parts.alias("n_parts"), chunks.alias("chunks")
    ).select(*kept, "filename", "checksum", "n_parts", F.posexplode("chunks").alias("part_no", "content"))
    split = F.col("n_parts") > 1
    chunk_name = F.concat(F.lit("chunk."), F.format_string("%03d", F.col("part_no")))
    return parts.select(
        *kept,
        F.when(split, F.col("filename")).alias("original"),
        F.when(split, chunk_name).otherwise(F.col("filename")).alias("filename"),
        "part_no",
        "n_parts",
        "checksum",
        "content",
    )


def part_headers(parts: DataFrame) -> Column:
    """Transport headers of a part: its number, original name and the checksum of the whole."""
    whole = F.create_map(F.lit("x-transport-md5"), F.col("checksum"))
    place = F.concat(F.col("part_no").cast("string"), F.lit("/"), F.col("n_parts").cast("string"))
    split = F.create_map(F.lit("x-transport-part"), place, F.lit("x-transport-filename"), F.col("original"))
    return F.when(F.col("n_parts") > 1, F.map_concat(split, whole)).otherwise(whole)


def _collect_parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Number the assemblies of each file in article order: a file is complete, and the next
    begins, once as many different parts came as the latest part says there are.

    Rows come sorted by file and article; only the part numbers of one file are held."""
    current, seen, number = None, set(), 1
    for frame in frames:
        groups = frame["newsgroup"].to_numpy()
        names = frame["original"].to_numpy()
        parts = frame["part_no"].to_numpy()
        totals = frame["n_parts"].to_numpy()
        out = np.empty(len(frame), dtype="int64")
        for i in range(len(frame)):
            key = (groups[i], names[i])
            if key != current:
                current, seen, number = key, set(), 1
            out[i] = number
            seen.add(parts[i])
            if len(seen) == totals[i]:
                seen, number = set(), number + 1
        yield frame.assign(assembly=out)


def assemblies(parts: DataFrame, block_size: int = scan.BLOCK) -> DataFrame:
    """Which assembly of its file each part belongs to (``newsgroup, original, article_number,
    part_no, n_parts`` to ``assembly``).

    A file may be posted again and again under one name. Where its parts come in whole
    rounds, the assembly is how often the part number came before, which the blocked scans
    count without gathering the file. Only files whose rounds are broken (lost or repeated
    parts) are walked in article order, on these narrow columns. Starts jobs when called."""
    rows = parts.select(*FILE, "article_number", "part_no", "n_parts")
    counted = scan.running(
        rows, [*FILE, "part_no"], "article_number", {"assembly": scan.running_count()}, block_size
    )
    # each scan reads its input twice, and both branches below read the result
    counted = scan.running(stage(counted, "counted"), FILE, "article_number", {"position": scan.running_count()}, block_size)
    counted = stage(counted, "positions")
    in_round = F.ceil(F.col("position") / F.col("n_parts")) == F.col("assembly")
    files = counted.groupBy(*FILE).agg(
        (F.bool_and(in_round) & (F.min("n_parts") == F.max("n_parts"))).alias("whole_rounds")
    )
    judged = counted.join(files, FILE)
    regular = judged.filter("whole_rounds").drop("position", "whole_rounds")
    broken = (
        judged.filter(~F.col("whole_rounds"))
        .drop("position", "whole_rounds", "assembly")
        .repartition(*FILE)
        .sortWithinPartitions(*FILE, "article_number")
        .mapInPandas(
            _collect_parts,
            "newsgroup string, original string, article_number bigint, part_no int, n_parts int, assembly bigint",
        )
    )
    return regular.select(broken.columns).unionByName(broken)


def join_parts(parts: DataFrame, block_size: int = scan.BLOCK, placed: DataFrame | None = None) -> DataFrame:
    """Put split files together again: content of complete ones, and whether it is the original.

    ``parts`` has ``newsgroup, article_number, original, part_no, n_parts, checksum, content``
    and, where files that were not split (``original`` null) are among them, ``filename``: these
    pass unchanged, without assembly. A part that came twice before its file was complete
    counts with its later content.
    ``placed`` is the result of :func:`assemblies` where the caller has it already."""
    whole = parts.filter("original IS NULL")
    parts = parts.filter("original IS NOT NULL")
    placed = assemblies(parts, block_size) if placed is None else placed
    # The later of repeated parts, and how many different ones there are: still metadata.
    kept = placed.groupBy(*FILE, "assembly", "part_no").agg(
        F.max("article_number").alias("article_number"), F.max_by("n_parts", "article_number").alias("n_parts")
    )
    with_content = kept.join(
        parts.select("newsgroup", "article_number", "checksum", "content"), ["newsgroup", "article_number"]
    )
    grouped = with_content.groupBy(*FILE, "assembly").agg(
        F.max("article_number").alias("article_number"),
        F.max_by("n_parts", "article_number").alias("n_parts"),
        F.count("*").alias("n_received"),
        F.max_by("checksum", "article_number").alias("checksum"),
        F.expr("listagg(content) WITHIN GROUP (ORDER BY part_no)").alias("content"),
    )
    complete = F.col("n_received") == F.col("n_parts")
    joined = grouped.withColumn("content", F.when(complete, F.col("content")))
    if "filename" in whole.columns:
        one = F.lit(1).cast("bigint")
        joined = joined.unionByName(
            whole.select(
                "newsgroup", F.col("filename").alias("original"), F.lit(None).cast("bigint").alias("assembly"),
                "article_number", "n_parts", one.alias("n_received"), "checksum", "content",
            )
        )
        complete = F.col("n_received") == F.col("n_parts")
    status = (
        F.when(~complete, INCOMPLETE)
        .when(F.col("checksum").isNull(), UNCHECKED)
        .when(F.col("checksum") == checksum(F.col("content")), OK)
        .otherwise(MISMATCH)
    )
    return joined.withColumn("status", status).withColumnRenamed("original", "filename")


# ------------------------------------------------------------- compression


def _changed(files: DataFrame, change: Callable[[str, bytes], tuple], added: str) -> DataFrame:
    """Files with the ``(filename, content, added column)`` that ``change`` makes of each, handed on
    by bytes, not by rows: a task holds one batch of what it reads and little of what it makes."""
    name, kind = added.split()
    arrow = {"bigint": pa.int64(), "string": pa.string()}[kind]

    def made(rows: pa.RecordBatch, done: list[tuple]) -> pa.RecordBatch:
        names, contents, extra = zip(*done)
        new = {"filename": names, "content": contents}
        columns = [pa.array(new[f.name], f.type) if f.name in new else rows.column(f.name) for f in rows.schema]
        return pa.RecordBatch.from_arrays([*columns, pa.array(extra, arrow)], [*rows.schema.names, name])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, start, size = [], 0, 0
            for k, (old, content) in enumerate(zip(batch.column("filename"), batch.column("content"))):
                content = content.as_py()
                done.append(change(old.as_py(), content))
                size += len(content) + len(done[-1][1] or b"")
                if size >= SLICE_BYTES:
                    yield made(batch.slice(start, len(done)), done)
                    done, start, size = [], k + 1, 0
            if done:
                yield made(batch.slice(start, len(done)), done)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)
    return files.mapInArrow(run, f"{schema}, {added}")


def compress(files: DataFrame) -> DataFrame:
    """bz2 of each file not yet compressed, name extended, with old and new size."""

    def pack(name: str | None, content: bytes) -> tuple:
        if name is None or name.endswith(".bz2"):
            return name, content, len(content)
        return name + ".bz2", bz2.compress(content, 9), len(content)

    packed = _changed(files, pack, "original_bytes bigint")
    size = F.octet_length("content")
    percent = F.when(F.col("original_bytes") > 0, size / F.col("original_bytes") * 100).otherwise(0.0)
    return packed.withColumn("percent", percent)


def uncompress(files: DataFrame) -> DataFrame:
    """Expand .gz and .bz2 files and drop the extension; failures keep no content and say why."""

    def expand(name: str, content: bytes) -> tuple[str, bytes | None, str | None]:
        try:
            if name.endswith(".gz"):
                return name[:-3], gzip.decompress(content), None
            if name.endswith(".bz2"):
                return name[:-4], bz2.decompress(content), None
        except (OSError, EOFError, ValueError, zlib.error) as err:
            return name, None, f"{type(err).__name__}: {err}"
        return name, content, None

    return _changed(files, expand, "error string")


# ----------------------------------------------------------------- archive


def archive_rows(
    files: DataFrame, max_messages: int = 1, overwrite: bool = True, existing: DataFrame | None = None
) -> DataFrame:
    """The rows that end up in each destination (metadata only: ``newsgroup, dest, article_number,
    part_no``, ``batch_id`` unless one message makes a file).

    A batch starts its files anew and appends to them; so the last batch stays. With one
    message per file the last file stays. Without overwriting, the first file stays, unless
    the destination (``existing.dest``) was there before."""
    place = F.struct("article_number", "part_no")
    if not overwrite:
        if existing is not None:
            files = files.join(existing.select("dest").distinct(), "dest", "left_anti")
        winner = files.groupBy("newsgroup", "dest").agg(F.min(place).alias("__w"))
        match = place == F.col("__w")
    elif max_messages == 1:
        winner = files.groupBy("newsgroup", "dest").agg(F.max(place).alias("__w"))
        match = place == F.col("__w")
    else:
        winner = files.groupBy("newsgroup", "dest").agg(F.max("batch_id").alias("__w"))
        match = F.col("batch_id") == F.col("__w")
    return files.join(winner, ["newsgroup", "dest"]).filter(match).drop("__w")


def archive_chunks(rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, block_size: int = scan.BLOCK) -> DataFrame:
    """Concatenate each destination's contents in article order, in chunks of about
    ``chunk_bytes``: one chunk for an ordinary file, as many as needed for a feed that is
    appended to one file for ever. ``rows`` has ``newsgroup, dest, article_number, part_no, content``."""
    sized = rows.withColumn("__n", F.octet_length("content").cast("bigint"))
    meta = scan.running(
        sized.select("newsgroup", "dest", "article_number", "part_no", "__n"),
        ["newsgroup", "dest"], ["article_number", "part_no"],
        {"__before": scan.running_sum(F.col("__n"), inclusive=False)}, block_size,
    )
    placed = meta.withColumn("chunk_no", F.floor(F.col("__before") / F.lit(chunk_bytes)))
    keys = ["newsgroup", "dest", "article_number", "part_no"]
    joined = rows.join(placed.select(*keys, "chunk_no"), keys)
    return joined.groupBy("newsgroup", "dest", "chunk_no").agg(
        F.count("*").alias("n_files"),
        F.expr("listagg(content) WITHIN GROUP (ORDER BY struct(article_number, part_no))").alias("content"),
    )


def write_archive(
    files: DataFrame,
    root: str,
    max_messages: int = 1,
    overwrite: bool = True,
    existing: DataFrame | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    block_size: int = scan.BLOCK,
) -> DataFrame:
    """Archive ``files`` below ``root/<newsgroup>``: who stays in each destination is decided on
    metadata, contents are joined once, and each destination's chunks go, in their order,
    into one file. A row per file: ``dest, n_bytes``. Lazy, as :func:`write_files`."""
    keys = ["newsgroup", "article_number", "part_no"]
    staying = archive_rows(files.drop("content"), max_messages, overwrite, existing)
    rows = staying.select("dest", *keys).join(files.select(*keys, "content"), keys)
    chunks = archive_chunks(rows, chunk_bytes, block_size)
    return write_files(chunks.withColumn("dest", F.concat_ws("/", "newsgroup", "dest")), root)
