"""Approximate nearest neighbours by inner product: randomly rotated one-bit codes.

Vectors are centred, scaled to length one and rotated at random; the signs of their
coordinates, packed, are their code. Two scalars go with it: the vector's distance
from the centre and the inner product of the scaled vector with its own code. From
these the inner product with a query is estimated without bias, and with an error
that stays under a bound with high probability. Within a block, a vector is compared
exactly only if its upper bound reaches the TOP-th best lower bound.

Rows are deduplicated first: of equal vectors only the ids that can be in an answer,
the smallest TOP + 1, are kept, so a vector with very many copies is one candidate.
Blocks of distinct vectors meet blocks of distinct queries on a grid; a task holds
one block of each. Every task returns at most TOP + 1 rows a query; the best of them
are taken by window with a limit before the shuffle.

The centre is fitted on at most SAMPLE distinct vectors; every vector is indexed.

Defined results: vectors that are null, zero, of another dimension than the most
frequent one (ties: the larger), or that hold null or non-finite components take no
part, nor do rows without vec_id; repeated rows count once; equal scores go to the
smaller vec_id; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.plans.storage import stage

SAMPLE = 4096
BLOCK = 16_384
QUERY_BLOCK = 4_096


def _valid(vectors: DataFrame) -> DataFrame:
    """(vec_id, key, dim, vector): usable rows, the vector as bytes of doubles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, dims, out = [], [], [], []
            for i, x in zip(batch.column("vec_id").to_pylist(), batch.column("embedding")):
                if i is None or not x.is_valid or x.values.null_count:
                    continue
                row = x.values.to_numpy(zero_copy_only=False).astype("<f8")
                if np.isfinite(row).all() and row.any():
                    coded = row.tobytes()
                    ids.append(i)
                    keys.append(hashlib.blake2b(coded, digest_size=16).digest())
                    dims.append(len(row))
                    out.append(coded)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64()), "key": pa.array(keys, pa.binary()), "dim": pa.array(dims, pa.int32()), "vector": pa.array(out, pa.binary())})

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, key binary, dim int, vector binary")


class Codes:
    """The rotation and the centre, and what they make of vectors."""

    def __init__(self, dim: int, centre: np.ndarray, seed: int = 7):
        self.dim, self.centre = dim, centre
        self.rotation, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))

    def encode(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Packed signs, distance from the centre, inner product of unit vector and code."""
        apart = (rows - self.centre) @ self.rotation
        norm = np.linalg.norm(apart, axis=1)
        unit = apart / np.where(norm > 0, norm, 1)[:, None]
        fit = np.abs(unit).sum(1) / np.sqrt(self.dim)
        return np.packbits(unit > 0, axis=1), norm, np.where(norm > 0, fit, 1.0)

    def estimate(self, packed: np.ndarray, norm: np.ndarray, fit: np.ndarray, queries: np.ndarray, sure: float) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of the inner products (vectors by queries), and their error bounds."""
        signs = np.unpackbits(packed, axis=1, count=self.dim).astype(np.float32) * 2 - 1
        turned = queries @ self.rotation
        scale = (norm / fit / np.sqrt(self.dim)).astype(np.float32)
        got = (signs @ turned.T.astype(np.float32)) * scale[:, None] + (queries @ self.centre).astype(np.float32)
        spread = norm * np.sqrt(np.maximum(1 - fit**2, 0)) / fit * sure / np.sqrt(max(1, self.dim - 1))
        return got, spread.astype(np.float32)[:, None] * np.linalg.norm(queries, axis=1).astype(np.float32)[None, :]


def nearest_in_block(codes: Codes, base: dict, queries: np.ndarray, top: int, sure: float) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Per query its number, and ids and exact scores of the block's best rows."""
    vectors, ids = base["vector"], base["ids"]
    out = []
    for first in range(0, len(queries), 256):
        some = queries[first : first + 256]
        got, error = codes.estimate(base["code"], base["norm"], base["fit"], some, sure)
        sureness = got - error
        limit = np.partition(sureness, len(vectors) - top, axis=0)[len(vectors) - top] if len(vectors) > top else np.full(len(some), -np.inf, np.float32)
        may = got + error >= limit[None, :]
        for j in range(len(some)):
            near = np.flatnonzero(may[:, j])
            exact = vectors[near] @ some[j]
            if len(near) > top:
                good = exact >= np.partition(exact, len(exact) - top)[len(exact) - top]
                near, exact = near[good], exact[good]
            own = np.concatenate([ids[b] for b in near])
            marks = np.repeat(exact, [len(ids[b]) for b in near])
            order = np.lexsort((own, -marks))[:top]
            out.append((first + j, own[order], marks[order]))
    return out


def search(vectors: DataFrame, every: int = 20, k: int = 20, sure: float = 2.5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row whose
    vec_id is divisible by `every`. sure: how many standard errors a bound has."""
    top = k + 1
    rows = stage(_valid(vectors), "vectors")
    dims = rows.groupBy("dim").count().orderBy(F.desc("count"), F.desc("dim")).first()
    dim = dims["dim"] if dims else 1
    rows = rows.where(F.col("dim") == dim).drop("dim").dropDuplicates(["vec_id", "key"])
    rank = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.withColumn("rank", rank).where(F.col("rank") <= top)
    distinct = stage(few.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("vector", "rank").alias("vector")), "distinct")
    asked = rows.where(F.col("vec_id") % every == 0).select("key", F.col("vec_id").alias("query_id"))
    sample = distinct.orderBy("key").limit(SAMPLE).select("vector").collect()
    centre = np.mean([np.frombuffer(r["vector"], "<f8") for r in sample], axis=0) if sample else np.zeros(dim)
    codes = Codes(dim, centre)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("vector").to_pylist()), "<f8").reshape(-1, dim)
            packed, norm, fit = codes.encode(x)
            more = {"code": pa.array([p.tobytes() for p in packed], pa.binary()), "norm": norm, "fit": fit}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in ("key", "ids", "vector")} | more)

    index = stage(distinct.mapInArrow(encode, "key binary, ids array<long>, vector binary, code binary, norm double, fit double"), "codes")
    queries = stage(distinct.join(asked.select("key").distinct(), "key").select("key", "vector"), "queries")
    blocks, query_blocks = (max(1, -(-df.count() // size)) for df, size in ((index, BLOCK), (queries, QUERY_BLOCK)))

    def each(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def own(n: int):
        return F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")

    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("ids", "array<long>"), ("code", "binary"), ("norm", "double"), ("fit", "double"))]
    base = index.select(own(blocks).alias("block"), each(query_blocks).alias("asking"), "key", "vector", "ids", "code", "norm", "fit")
    asks = queries.select(each(blocks).alias("block"), own(query_blocks).alias("asking"), "key", "vector", *nothing)

    def meet(table: pa.Table) -> pa.Table:
        is_query = table.column("code").is_null()
        mine, theirs = table.filter(pa.compute.invert(is_query)), table.filter(is_query)
        out = []
        if len(mine) and len(theirs):
            matrix = lambda t: np.frombuffer(b"".join(t.column("vector").to_pylist()), "<f8").reshape(-1, dim)
            block = {c: mine.column(c).to_numpy() for c in ("norm", "fit")} | {"vector": matrix(mine), "ids": [np.array(x, np.int64) for x in mine.column("ids").to_pylist()]}
            block["code"] = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(len(mine), -1)
            out = nearest_in_block(codes, block, matrix(theirs), top, sure)
        keys = theirs.column("key").to_pylist()
        return pa.table({
            "key": pa.array([keys[q] for q, ids, _ in out for _ in ids], pa.binary()),
            "vec_id": np.concatenate([ids for _, ids, _ in out]) if out else pa.array([], pa.int64()),
            "score": np.concatenate([s for _, _, s in out]) if out else pa.array([], pa.float64()),
        })

    met = base.union(asks).groupBy("block", "asking").applyInArrow(meet, "key binary, vec_id long, score double")
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "vec_id"))
    found = met.withColumn("rank", best).where(F.col("rank") <= top).drop("rank")
    # the query's own row is among them at most once, so one more than k is enough
    answer = found.join(asked, "key").where("vec_id <> query_id")
    final = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return answer.withColumn("rank", final).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
