import hashlib
import math
import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import clusters


def brute(rows, k=16, rounds=3, size=64):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(64 * x) < 2**53 for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(x) // len(vs) for x in zip(*vs)]
    at = [(i, *reversed(nearest(v))) for i, v in kept]
    fit = lambda x: x if x < 2**63 else None
    sums = {j: sum(d for _, c, d in at if c == j) for _, j, _ in at}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, fit(d), fit(sums[j]), fit(sum(sums.values())), digest[j]) for i, j, d in at), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<double>"


def test_tables_equal_differences():
    rng = np.random.default_rng(2)
    for scale in (10, 1 << 40):
        vectors, centroids = rng.integers(-scale, scale, (200, 9)), rng.integers(-scale, scale, (5, 9))
        exact = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in vectors]
        nearest, distance = clusters.assign(vectors, centroids)
        assert nearest.tolist() == [min(range(5), key=lambda j: (e[j], j)) for e in exact]
        assert [int(x) for x in distance] == [min(e) for e in exact]


def test_rows(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(i % 5, 1) for _ in range(64)]) for i in range(150)]
    hot = [7.25] * 64
    rows += [(1000 + i, hot) for i in range(70)] + rows[:5] + [(None, hot), (None, rows[3][1])]
    bad = [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [1.0] * 63 + [None]), (2004, [1.0] * 63 + [math.nan]), (2005, [math.inf] + [0.0] * 63), (2006, [1e300] * 64)]
    df = spark.createDataFrame(rows + bad, SCHEMA)
    for name in ("id", "v", "cluster", "distance", "x"):
        df = df.withColumn(name, F.lit("own"))
    assert found(clusters.cluster(df.repartition(3))) == brute(rows + bad)


def test_wide_integers(spark):
    rows = [(i, [(-1.0) ** (i * d) * 10.0 ** (i % 14) for d in range(64)]) for i in range(60)]
    assert found(clusters.cluster(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_few_and_none(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)] + [(9, [0.0] * 64)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(clusters.cluster(df)) == brute(rows)
    assert clusters.cluster(df.limit(0)).count() == 0
    assert clusters.cluster(spark.createDataFrame([(1, [1.0])], SCHEMA)).count() == 0
