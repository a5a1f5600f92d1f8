"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Hierarchical residual packing. Each partition of the documents packs its own pieces
by best fit, longest first, and emits the nearly full sequences. Its underfull ones
become the items of a tree: partitions are grouped, a group packs the underfull
sequences of its members by best fit again, emits what is nearly full, and hands
the rest up, until one group is left.

A sequence is also emitted once it cannot change the number of sequences. After a
best-fit round no two sequences of a group fit together, so at most one is half full
or less. A sequence over half full can only take in one that is at most half full,
and of those there are as many as groups. So a group hands up its one small sequence
and, of the others, as many as there are small sequences in the whole round, those
with the most room. Rows handed up are bounded by the groups, not by the documents.

Pieces never move: they are written once, with the sequence they were first put in,
and only join the short list of sequences that were moved into others.

Defined results: a null or empty text is one piece that holds the end id alone;
repeated rows and rows without doc_id are packed each for itself; ties go to the
earlier row; no documents give no sequences; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.tokens import encoder, public_path
from tidewire.plans.storage import stage

FAN_IN = 16
PIECES = "piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, fill long"


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per item its bin and its place there, and the fill of each bin; longest items
    first, each into the fullest bin that still takes it."""
    bins, places = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # the sizes of room that some bin has, ascending
    fill: list[int] = []
    for item in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[item])
        at = bisect_left(rooms, size)
        if at < len(rooms):
            left = rooms[at]
            bin_ = room[left].pop()
            if not room[left]:
                del rooms[at]
        else:
            bin_, left = len(fill), capacity
            fill.append(0)
        bins[item], places[item] = bin_, fill[bin_]
        fill[bin_] += size
        if left := left - size:
            if not room[left]:
                insort(rooms, left)
            room[left].append(bin_)
    return bins, places, np.array(fill, np.int64)


def token_pieces(docs: DataFrame, capacity: int, end_id: int, tokenizer: str) -> DataFrame:
    """The pieces of all documents, each in a sequence of its partition. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        ids, rows, starts, sizes, sums = [], [], [], [], []
        count = 0
        for batch in batches:
            texts = batch.column("text")
            ids.append(batch.column("doc_id"))
            for at in range(0, len(texts), 64):
                for coded in coder.encode(texts.slice(at, 64).to_pylist()):
                    coded += end
                    for first in range(0, len(coded), 4 * capacity):
                        part = coded[first : first + 4 * capacity]
                        rows.append(count)
                        starts.append(first // 4)
                        sizes.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                    count += 1
        if not rows:
            return
        size = np.array(sizes, np.int64)
        start = np.array(starts, np.int64)
        bins, places, fill = best_fit(size, capacity)
        base = TaskContext.get().partitionId() << 32
        own = pa.chunked_array(ids).take(pa.array(rows, pa.int64()))
        table = pa.table({"doc_id": own, "piece": pa.array(start // capacity, pa.int32()), "start": start, "length": size, "ids_crc32": pa.array(sums, pa.int64()), "sequence_id": bins + base, "offset": places, "fill": fill[bins]})
        yield from table.to_batches(max_chunksize=65536)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def _round(open_: DataFrame, capacity: int) -> DataFrame:
    """Best fit of the sequences (sequence_id, fill) of each node: the sequence each
    goes to, its place there, and the fill of that one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("fill", "descending"), ("sequence_id", "ascending")])
        own = table.column("sequence_id").to_numpy()
        bins, places, fill = best_fit(table.column("fill").to_numpy(), capacity)
        to = np.zeros(len(fill), np.int64)
        first = places == 0
        to[bins[first]] = own[first]
        return pa.table({"sequence_id": own, "to": to[bins], "place": places, "filled": fill[bins], "node": table.column("node")})

    return open_.groupBy("node").applyInArrow(run, "sequence_id long, to long, place long, filled long, node long")


def _handed_up(sequences: DataFrame, capacity: int, nearly_full: int) -> DataFrame:
    """Of (node, sequence_id, fill) those that a higher round can still use."""
    open_ = sequences.where(F.col("fill") < nearly_full)
    small = F.col("fill") <= capacity // 2
    counted = open_.agg(F.sum(small.cast("long")).alias("n"), F.min("fill").alias("least")).first()
    if not counted["n"]:
        return open_.limit(0)
    rank = F.row_number().over(Window.partitionBy("node").orderBy("fill", "sequence_id"))
    fits = small | (F.col("fill") + counted["least"] <= capacity)
    return open_.where(fits).withColumn("rank", rank).where(F.col("rank") <= counted["n"] + 1).drop("rank")


def pack(docs: DataFrame, capacity: int = 4096, end_id: int = 1, nearly_full: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece.

    A document is its token ids and end_id. Longer ones than capacity are cut into
    pieces of capacity, the last as long as it comes. nearly_full: tokens from which
    a sequence is emitted (default: all but 32 of the capacity)."""
    nearly_full = nearly_full or capacity - 32
    pieces = stage(token_pieces(docs, capacity, end_id, tokenizer or public_path()), "pieces")
    first = pieces.where("offset = 0").select(F.shiftright("sequence_id", 32).alias("node"), "sequence_id", "fill")
    open_ = stage(_handed_up(first, capacity, nearly_full), "underfull")
    moved = None
    nodes = (open_.agg(F.max("node")).first()[0] or 0) + 1
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        done = stage(_round(open_.withColumn("node", F.floor(F.col("node") / FAN_IN)), capacity), "round")
        step = done.select("sequence_id", "to", "place")
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("sequence_id").alias("to"), F.col("to").alias("next"), F.col("place").alias("further"))
            moved = moved.join(later, "to", "left").select("sequence_id", F.coalesce("next", "to").alias("to"), (F.col("place") + F.coalesce("further", F.lit(0))).alias("place"))
            moved = stage(moved, "moved")
        heads = done.where("place = 0").select("node", "sequence_id", F.col("filled").alias("fill"))
        open_ = stage(_handed_up(heads, capacity, nearly_full), "underfull")
    out = pieces.drop("fill")
    if moved is None:
        return out
    moved = stage(moved.where("sequence_id <> to"), "moved")
    joined = out.join(moved, "sequence_id", "left")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("place", F.lit(0))).alias("offset"))
