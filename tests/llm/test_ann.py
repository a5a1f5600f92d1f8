import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import ann

ROWS = "vec_id long, embedding array<float>, label int"


def brute(ids, x, every=20, k=20):
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = x @ x[i]
        order = [j for j in np.lexsort((ids, -scores)) if ids[j] != ids[i]][:k]
        out[int(ids[i])] = [(int(ids[j]), float(scores[j])) for j in order]
    return out


def collect(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def recall(found, expected):
    hit = sum(len({i for i, _ in found[q]} & {i for i, _ in e}) for q, e in expected.items())
    return hit / sum(map(len, expected.values()))


@pytest.mark.parametrize("block", [16_384, 37])
def test_recall_on_the_given_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(ann, "BLOCK", block)
    monkeypatch.setattr(ann, "QUERY_BLOCK", block // 2)
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r["vec_id"] for r in rows]), np.array([r["embedding"] for r in rows], np.float64)
    found, expected = collect(ann.search(table)), brute(ids, x)
    assert found.keys() == expected.keys() and all(len(found[q]) == len(expected[q]) for q in expected)
    assert recall(found, expected) > 0.98
    for q, own in found.items():
        for i, s in own:
            assert np.isclose(s, x[ids == i][0] @ x[ids == q][0], rtol=1e-12, atol=1e-12)


def test_estimates_stay_within_bounds():
    rng = np.random.default_rng(1)
    x, q = rng.standard_normal((3000, 64)) + 0.3, rng.standard_normal((50, 64))
    codes = ann.Codes(64, x.mean(0))
    got, error = codes.estimate(*codes.encode(x), q, 2.5)
    apart = np.abs(got - x @ q.T)
    assert (apart <= error).mean() > 0.98 and abs((got - x @ q.T).mean()) < 0.05


def test_copies_ties_and_bad_rows(spark):
    rng = np.random.default_rng(2)
    hot = [float(v) for v in rng.standard_normal(8).astype("f4")]
    rows = [(i, hot, 0) for i in range(0, 300)] + [(i, [float(v) for v in rng.standard_normal(8).astype("f4")], 0) for i in range(300, 400)]
    bad = [(1000, None, 0), (1020, [0.0] * 8, 0), (1040, [float("nan")] * 8, 0), (1060, [1.0] * 7, 0), (1080, [None] + hot[1:], 0), (None, hot, 0), (1100, [], 0)]
    table = spark.createDataFrame(rows + rows[:50] + bad, ROWS).withColumn("key", F.lit("clash"))
    found = collect(ann.search(table))
    expected = brute(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(np.float64))
    assert found.keys() == expected.keys() and recall(found, expected) > 0.95
    assert [i for i, _ in found[40]] == [i for i in range(21) if i != 40][:20] and [i for i, _ in found[0]] == list(range(1, 21))
    assert ann.search(table.limit(0)).count() == 0
    assert [len(v) for v in collect(ann.search(table.where("vec_id in (0, 1, 300)"))).values()] == [2, 2]
