"""SimHash near-duplicates by vantage-point trees over Hamming distance.

A tree level has a vantage fingerprint and a block of bits. The Hamming distance of
a fingerprint to the vantage point within the block is its shell at that level. For
two fingerprints that differ in k bits the triangle inequality holds within each
block, and the blocks are disjoint, so their shells differ by at most k summed over
the levels. The first levels, four blocks of 16 bits, split the fingerprints into
shards: each fingerprint lives in one shard and is also sent, as a query, to every
shard its ball of k bits can reach. Of each two shards only the lower one visits
the other. In a shard the tree goes on over blocks of 8 bits, spending each query's
rest of the bound; what is left at the leaves is compared bit by bit. The pairs found
are exact: no candidate is capped.

Only distinct fingerprints go through the tree, so copies cost nothing there. A
shard of more than SHARD_LIMIT fingerprints is dealt over several tasks. A task
reports the links it found as a spanning forest, never as all pairs of a group.

Defined results: null and empty texts and texts of white space alone have the
fingerprint zero, linked like any other. Repeated rows are one class. A null doc_id
takes part but is never a component_id unless no row of its component has an id.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.components import components
from tidewire.llm.words import solid_words
from tidewire.plans.storage import stage

SHARD_LIMIT = 40_000
#: A shard level's fullest shell has about this share of evenly spread fingerprints.
_FULLEST = 0.2
_BLOCK = 0xFFFF
_LEVELS = 4
_VANTAGE_SAMPLE = 512


def fingerprint(text: str | None, shingle: int) -> int:
    """The 64 majority bits of the hashes of all word shingles, repeats included."""
    words = solid_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    ends = [x - 1 for x in accumulate(len(w) + 1 for w in words)]
    starts = [0] + [x + 1 for x in ends[:-1]]
    hash_of = xxhash.xxh64_intdigest
    hashes = [hash_of(joined[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :])] or [hash_of(joined, 42)]
    values = np.array(hashes, np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(values), 65536):
        ones += np.unpackbits(values[at : at + 65536].view(np.uint8)).reshape(-1, 64).sum(0, np.int64)
    return int(np.packbits(2 * ones > len(values)).view(np.int64)[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed number. One narrow pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def vantage_points(distinct: DataFrame, masks: list[int]) -> list[int]:
    """Per block of bits the fingerprint, of a bounded sample, from which distances spread most."""
    rows = distinct.orderBy(F.xxhash64("fp"), "fp").limit(_VANTAGE_SAMPLE).collect()
    sample = np.array([r["fp"] for r in rows], np.int64).view(np.uint64)
    best = []
    for mask in masks:
        shells = np.bitwise_count((sample[:, None] ^ sample[None, :]) & np.uint64(mask))
        best.append(int(sample[shells.astype(np.float32).var(1).argmax()]) if len(sample) else 0)
    return best


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links(distinct: DataFrame, bits: int = 3) -> DataFrame:
    """A spanning forest (a, b) of the pairs of distinct fingerprints (fp) at most `bits` apart."""
    n = distinct.count()
    levels = next((k for k in range(2, _LEVELS) if n * _FULLEST**k <= SHARD_LIMIT / 4), _LEVELS)
    masks = [_BLOCK << (16 * k) for k in range(_LEVELS)]
    vantage = vantage_points(distinct, masks)
    shell = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(_signed(v))).bitwiseAND(F.lit(_signed(m)))) for v, m in zip(vantage, masks)]
    at_home = distinct.select("fp", F.array(*shell[:levels]).alias("place"))

    def shard(place):
        return sum((place[k].cast("long") * F.lit(17**k) for k in range(levels)), F.lit(0).cast("long"))

    steps = [s for s in product(range(-bits, bits + 1), repeat=levels) if sum(map(abs, s)) <= bits and s > (0,) * levels]
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in steps])).alias("step")
    visits = at_home.select("fp", "place", step).select("fp", F.zip_with("place", "step", lambda a, b: a + b).alias("place"))
    visits = visits.where(F.forall("place", lambda x: (x >= 0) & (x <= 16))).select("fp", shard(F.col("place")).alias("shard"))
    homes = at_home.select("fp", shard(F.col("place")).alias("shard"))
    parts = stage(homes.groupBy("shard").agg(F.ceil(F.count("*") / SHARD_LIMIT).cast("int").alias("parts")), "shards")
    homes = homes.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("fp"), "parts"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))
    guests = visits.join(parts, "shard").select("shard", "fp", every.alias("part"))
    own = homes.where("parts > 1").select("shard", "fp", "parts", "part").select("shard", "fp", "part", every.alias("to"))
    dealt = (
        homes.select("shard", "part", "fp", F.lit(True).alias("home"))
        .union(guests.select("shard", "part", "fp", F.lit(False)))
        .union(own.where("to <> part").select("shard", F.col("to"), "fp", F.lit(False)))
    )

    def run(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy().view(np.uint64)
        home = table.column("home").to_numpy(zero_copy_only=False)
        a, b = forest(np.concatenate([fp[home], fp[~home]]), int(home.sum()), vantage, bits)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    return dealt.groupBy("shard", "part").applyInArrow(run, "a long, b long")


def forest(nodes: np.ndarray, homes: int, vantage: list[int], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within `bits` that join each of the first `homes` nodes to any node, as a spanning forest."""
    parent = np.arange(len(nodes))
    for mine, theirs in _close(nodes, np.arange(homes), np.arange(len(nodes)), np.full(len(nodes), bits), 0, vantage, bits):
        _unite(parent, mine, theirs)
    below = np.flatnonzero(parent != np.arange(len(nodes)))
    return nodes[below], nodes[_roots(parent, below)]


def _close(nodes, mine, queries, rest, level, vantage, bits):
    """Pairs of nodes (mine, query) within `bits`; rest: what the levels above left of each query's bound."""
    if len(mine) * len(queries) <= 1 << 20 or level == 8:
        for at in range(0, len(mine), max(1, (1 << 22) // max(1, len(queries)))):
            some = mine[at : at + max(1, (1 << 22) // max(1, len(queries)))]
            apart = np.bitwise_count(nodes[some][:, None] ^ nodes[queries][None, :])
            i, j = np.nonzero((apart <= bits) & (apart > 0))
            yield some[i], queries[j]
        return
    mask, point = np.uint64(0xFF << (8 * level)), np.uint64(vantage[level // 2])
    shells = np.bitwise_count((nodes[mine] ^ point) & mask)
    reach = np.bitwise_count((nodes[queries] ^ point) & mask).astype(np.int64)
    for shell in np.unique(shells):
        left = rest - np.abs(reach - int(shell))
        near = left >= 0
        yield from _close(nodes, mine[shells == shell], queries[near], left[near], level + 1, vantage, bits)


def _roots(parent: np.ndarray, of: np.ndarray) -> np.ndarray:
    root = parent[of]
    while not np.array_equal(up := parent[root], root):
        root = up
    return root


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        ra, rb = _roots(parent, a), _roots(parent, b)
        parent[a], parent[b] = ra, rb
        apart = ra != rb
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])


def near_duplicates(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id, root) per row of docs: component_id is the smallest
    doc_id among all rows whose fingerprints are connected by links of at most `bits`,
    root the smallest of these fingerprints."""
    prints = stage(fingerprints(docs, shingle), "fingerprints")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = components(links(distinct.select("fp"), bits)).withColumnRenamed("node", "fp")
    named = distinct.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = stage(named, "classes")
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = stage(named.join(smallest, "root").select("fp", "component_id", "root"), "classes")
    return prints.join(classes, "fp").select("doc_id", "fp", "component_id", "root")


def keep_one(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """Of each component the document with the smallest doc_id, in the columns of docs.

    Of rows that repeat this doc_id within the component one stays. Different texts may
    share a doc_id: each component keeps one of them all the same, which takes the
    fingerprints of such rows once more. A row without doc_id cannot be told from others
    by name and stays. Only ids that are dropped or repeated are joined with the texts;
    where their table is small, Spark broadcasts it."""
    classes = stage(near_duplicates(docs, shingle, bits), "components")
    heads = F.bool_or(F.col("doc_id") == F.col("component_id")).alias("heads")
    ids = classes.where("doc_id is not null").groupBy("doc_id").agg(heads, F.count("*").alias("n"))
    decided = stage(ids.where("not heads or n > 1").select("doc_id", "heads"), "decided")
    kept = docs.join(decided.select("doc_id"), "doc_id", "left_anti").select(docs.columns)
    again = decided.where("heads").select("doc_id")
    if again.isEmpty():
        return kept
    stay = classes.where("doc_id = component_id").join(again, "doc_id", "left_semi").select("doc_id", "fp", "root").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "fp": pa.array(found, pa.int64()), "row": batch.column("row")})

    whole = docs.join(again, "doc_id", "left_semi").select("doc_id", "text", F.struct(*docs.columns).alias("row"))
    schema = whole.select("doc_id", F.lit(0).cast("long").alias("fp"), "row").schema
    one = whole.mapInArrow(run, schema).join(stay, ["doc_id", "fp"]).dropDuplicates(["doc_id", "root"])
    return kept.union(one.select("row.*"))
