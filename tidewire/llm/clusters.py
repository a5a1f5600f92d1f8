"""Centroid clustering of integer vectors with scalar lookup tables.

Components are scaled to integers, so that sums, means rounded down and squared distances
are exact and do not depend on the order of rows. For each batch of vectors and each
round, a table per dimension holds the squared difference of every integer value that
occurs there to every centroid. The distances of a batch are then gathers from these
tables, summed over the dimensions: no multiplication for each vector.

A round is one narrow pass; each task reports, per cluster it met, how many vectors and
which componentwise sums, and Spark adds these up. Only centroids (k vectors) come to the
driver and go to the tasks.

Defined results: vectors of another length, null vectors and vectors with null or
non-finite components take no part. Nor do vectors with a component of which the scaled
integer is beyond 2**53 - 1, where a double no longer tells integers apart. Distances and
inertias that do not fit in a long are null. A null id is hashed as the empty text.
Repeated rows count each for itself; of rows with equal ids those with the smaller vector
come first as start centroids. Fewer vectors than k give as many centroids; none, no rows.
Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.storage import stage

_EXACT = 2.0**53 - 1
#: Components and centroids up to here give squared distances and sums of a task that fit in 64 bits.
_SMALL = 1 << 26
_MOST = (1 << 63) - 1


def integers(vectors: DataFrame, key: str, vector: str, size: int, scale: float) -> DataFrame:
    """(id, v): the usable vectors, each component as floor(scale * component)."""
    v = F.transform(vector, lambda x: x.cast("double") * F.lit(float(scale)))
    usable = F.forall("x", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) <= F.lit(_EXACT)), F.lit(False)))
    scaled = vectors.where(F.size(vector) == size).select(F.col(key).alias("id"), v.alias("x")).where(usable)
    return scaled.select("id", F.transform("x", lambda x: F.floor(x).cast("long")).alias("v"))


def start(kept: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors with the smallest hashes of their ids, in the order of the hashes."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("")))
    rows = kept.select(F.sha2(name, 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    return [list(r["v"]) for r in rows]


def assign(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (the first of equals) and squared distance of each row, by lookup tables."""
    wide = max(np.abs(vectors).max(initial=0), np.abs(centroids).max(initial=0)) > _SMALL or vectors.shape[1] > 1 << 8
    kind = object if wide else np.int64
    total = np.zeros((len(vectors), len(centroids)), kind)
    for d in range(vectors.shape[1]):
        occurring, at = np.unique(vectors[:, d], return_inverse=True)
        table = (occurring.astype(kind)[:, None] - centroids[:, d].astype(kind)[None, :]) ** 2
        total += table[at]
    nearest = total.argmin(1)
    return nearest, total[np.arange(len(vectors)), nearest]


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def means(kept: DataFrame, centroids: np.ndarray, size: int) -> np.ndarray:
    """The centroids after one round: each the mean, rounded down, of its vectors; empty ones stay."""
    held = kept.sparkSession.sparkContext.broadcast(centroids)  # k vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(held.value), size), object)
        counts = np.zeros(len(held.value), np.int64)
        for batch in batches:
            vectors = _matrix(batch, size)
            nearest, _ = assign(vectors, held.value)
            kind = np.int64 if np.abs(vectors).max(initial=0) <= _SMALL else object
            for c in np.unique(nearest):
                mine = vectors[nearest == c]
                sums[c] += mine.astype(kind).sum(0).astype(object)
                counts[c] += len(mine)
        met = np.flatnonzero(counts)
        texts = pa.array([[Decimal(x) for x in sums[c]] for c in met], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(met, pa.int32()), "n": pa.array(counts[met], pa.int64()), "sums": texts})

    parts = kept.select("v").mapInArrow(run, "cluster int, n long, sums array<decimal(38,0)>")
    by_place = parts.select("cluster", "n", F.posexplode("sums").alias("d", "s"))
    # sums of up to 2**53 * rows: 38 digits hold 10**22 rows
    rows = by_place.groupBy("cluster", "d").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    out = centroids.copy()
    for r in rows:
        out[r["cluster"], r["d"]] = int(r["s"]) // r["n"]
    return out


def cluster(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    size: int = 64,
    scale: float = 64.0,
    seed: int = 1,
    key: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """Per usable vector: `key`, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    The digest is that of the cluster's last centroid, its integers joined by commas."""
    kept = stage(integers(vectors, key, vector, size, scale), "integers")
    centroids = np.array(start(kept, k, seed), np.int64).reshape(-1, size)
    for _ in range(rounds if len(centroids) else 0):
        centroids = means(kept, centroids, size)
    held = kept.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nearest, distance = assign(_matrix(batch, size), held.value)
            fits = distance if distance.dtype != object else [x if x <= _MOST else None for x in distance.tolist()]
            columns = [batch.column("id"), pa.array(nearest, pa.int32()), pa.array(fits, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "cluster", "distance"])

    kind = kept.schema["id"].dataType.simpleString()
    found = stage(kept.mapInArrow(run, f"id {kind}, cluster int, distance long"), "clusters")
    exact, some_wide = F.sum(F.col("distance").cast("decimal(38,0)")), F.bool_or(F.col("distance").isNull())
    by_cluster = found.groupBy("cluster").agg(F.when(~some_wide, exact).alias("sum")).collect()  # at most k rows
    sums = [r["sum"] for r in by_cluster]
    whole = None if None in sums else int(sum(sums))
    facts = []
    for r in by_cluster:
        inertias = (int(x) if x is not None and x <= _MOST else None for x in (r["sum"], whole))
        digits = ",".join(map(str, centroids[r["cluster"]].tolist()))
        facts.append((r["cluster"], *inertias, hashlib.sha256(digits.encode()).hexdigest()))
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    told = F.broadcast(kept.sparkSession.createDataFrame(facts, schema))  # at most k rows
    rows = found.join(told, "cluster")
    return rows.select(F.col("id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
