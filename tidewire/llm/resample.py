"""Target-distribution importance resampling over hashed n-grams.

A text is put into lower case (A-Z) and its separators are collapsed to single blanks.
One overlapped regular-expression scan then goes over it: a match starts at every word,
held there by lookarounds, and its groups end where the runs of one, two and three words
that start at it end. The CRC of a run goes on from the CRC of the run one word shorter,
so that every byte of a span is read once. The scan runs once for each text; what it finds
is written as two bytes a feature. Counting the buckets of both sides and weighing the
documents read those.

A bucket's gain compares its smoothed share in the target with that in the documents.
A document's weight is the sum of the gains of its features; perturbed by Gumbel noise
from a hash of its id, the highest scores are a draw without replacement. Ranks come from
one distributed sort of the scores: each task's rows are numbered, the sizes of the tasks
tell where each begins.

Only the counts of the buckets (at most 65 536) come to the driver and go to the tasks.

Defined results: null and empty texts and texts of separators alone have no features and
weight 0. A null id is hashed as the empty text and comes last among ties; repeated rows
are drawn each for itself, rows that tie in score and id in an order that is fixed by where
they were stored. With an empty target every gain still has its smoothed value; with no
documents there are no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.words import alnum_words
from tidewire.plans.storage import stage

BUCKETS = 10_000
_RUNS = regex.compile(rb"(?<![^ ])([^ ]++)( [^ ]++)?+( [^ ]++)?+(?![^ ])")
_MATCHES = 1 << 16
_ROW_BYTES = 16 << 20
_PLACE = (1 << 33) - 1


def scan(text: str | None, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the buckets of all runs of one to three words of a text."""
    words = alnum_words(text)
    collapsed = b" ".join(words)
    crc = zlib.crc32
    spans = _RUNS.finditer(collapsed, overlapped=True)
    found = []
    while some := list(islice(spans, _MATCHES)):
        codes = []
        add = codes.append
        for match in some:
            one, two, three = match.groups()
            code = crc(one)
            add(code)
            if two:
                code = crc(two, code)
                add(code)
                if three:
                    add(crc(three, code))
        found.append((np.array(codes, np.int64) % buckets).astype("<u2"))
    return len(words), np.concatenate(found) if found else np.zeros(0, "<u2")


def features(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_words, n_features, found) per row (id, text): found has two bytes for each feature."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be between 1 and 65536")

    def batch_of(ids: pa.Array, rows: list) -> pa.RecordBatch:
        counts = pa.array([n for n, _ in rows], pa.int64())
        sizes = pa.array([len(f) for _, f in rows], pa.int64())
        found = pa.array([f.tobytes() for _, f in rows], pa.binary())
        return pa.RecordBatch.from_arrays([ids, counts, sizes, found], ["id", "n_words", "n_features", "found"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows, first, held = batch.column("id"), [], 0, 0
            for i, text in enumerate(batch.column("text")):
                rows.append(scan(text.as_py(), buckets))
                held += 2 * len(rows[-1][1])
                if held >= _ROW_BYTES:
                    yield batch_of(ids[first : i + 1], rows)
                    rows, first, held = [], i + 1, 0
            if rows:
                yield batch_of(ids[first:], rows)

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, n_words long, n_features long, found binary")


def counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features each bucket has, over all rows; a task sends one row for each bucket it met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for cell in batch.column("found"):
                total += np.bincount(np.frombuffer(cell.as_buffer(), "<u2"), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(met, pa.int32()), "n": pa.array(total[met], pa.int64())})

    rows = found.select("found").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for row in rows:
        out[row["bucket"]] = row["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, rounded down."""
    size = float(len(source))
    s_all, t_all = float(source.sum()) + size, float(target.sum()) + size
    ratio = [(t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of `features`."""
    held = found.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(held.value[np.frombuffer(c.as_buffer(), "<u2")].sum()) for c in batch.column("found")]
            columns = [*(batch.column(c) for c in ("id", "n_words", "n_features")), pa.array(weights, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "n_features", "weight"])

    kind = found.schema["id"].dataType.simpleString()
    return found.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    """Add rank (1, 2, ... by score, highest first, then by id; null beyond k).

    The sorted rows are written with their place (task, position); ranks need the sizes of the tasks only."""
    sorted_rows = rows.orderBy(F.desc("score"), F.asc_nulls_last("id"), "at")
    placed = stage(sorted_rows.withColumn("place", F.monotonically_increasing_id()), "ranked")
    task = F.shiftright("place", 33)
    sizes = sorted((r["task"], r["n"]) for r in placed.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect())
    before = [0, *accumulate(n for _, n in sizes)]
    starts = rows.sparkSession.createDataFrame([(t, b) for (t, _), b in zip(sizes, before)], "task long, before long")
    rank = F.col("before") + F.col("place").bitwiseAND(F.lit(_PLACE)) + 1
    # a row for each task of the sort
    numbered = placed.withColumn("task", task).join(F.broadcast(starts), "task")
    return numbered.withColumn("rank", F.when(rank <= k, rank)).drop("task", "before", "place")


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = 5,
    min_words: int = 20,
    seed: int = 42,
    buckets: int = BUCKETS,
    key: str = "doc_id",
) -> DataFrame:
    """Every document's `key`, n_words, n_features, weight, score, and rank among those drawn (else null).

    `percent` of the documents with at least `min_words` words are drawn, as like the texts of
    `target` as their weights make them."""
    source = stage(features(docs.select(F.col(key).alias("id"), "text"), buckets), "features")
    wanted = features(target.select(F.lit(0).alias("id"), "text"), buckets)
    gain = gains(counts(source, buckets), counts(wanted, buckets))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = weigh(source, gain).withColumn("score", F.col("weight") + noise).withColumn("at", F.monotonically_increasing_id())
    scored = stage(scored, "scored")
    able = scored.where(F.col("n_words") >= min_words)
    drawn = ranked(able, able.count() * percent // 100)
    rest = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    both = drawn.unionByName(rest)
    return both.select(F.col("id").alias(key), "n_words", "n_features", "weight", "score", "rank")
