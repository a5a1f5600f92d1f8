import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import quality
from tidewire.llm.queries import QUERIES, table

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    rows = QUERIES["op4_quality"](spark, SF_DIR).join(table(spark, SF_DIR, "labels"), "doc_id").where("held_out").collect()
    right = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    bad = [r for r in rows if r["quality"] == 0]
    assert right > 0.95 and sum(r["predicted"] == 0 for r in bad) / len(bad) > 0.8, (right, len(rows), len(bad))


def test_dual_coordinate_descent_separates():
    rng = np.random.default_rng(1)
    rows = [np.unique(rng.integers(0, 50, 8)) + 50 * int(i % 2) for i in range(200)]
    labels = np.arange(200) % 2
    model = quality.fit_rows(rows, labels, np.arange(200) % 5 == 0, bits=8)
    scores = model.scores(np.array([model.margin(x) for x in rows]))
    assert ((scores >= 0.5) == (labels == 1)).all()


def test_features_are_distinct_and_local():
    features = quality.Features()
    one = features("A dog. a DOG!! a dog")
    assert len(set(one.tolist())) == len(one) and set(features("A dog.").tolist()) <= set(one.tolist())
    assert len(features(None)) == len(features(" \n")) == 0


def test_edges(spark, documents):
    docs = documents(*["good text here " * 3] * 8, *["BAD!! BAD!! BAD!!"] * 8, None, "", "w " * 100000).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 8)) for i in range(16)] + [(0, 1), (None, 1), (3, None)], "doc_id long, quality int")
    model = quality.fit(docs.union(docs), labels)
    rows = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in rows.values()) and rows[16] == rows[17] and rows[1] > 0.5 > rows[9]
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {0, 1, 7} <= {r["doc_id"] for r in kept.collect()}
    assert quality.score(docs.limit(0), model).count() == 0
    none = quality.fit(docs, labels.limit(0))
    assert {r["score"] for r in quality.score(docs, none).collect()} == {0.5}
    one = quality.fit(docs, labels.where("quality = 1"))
    assert all(r["score"] > 0.9 for r in quality.score(docs, one).collect())
    assert quality.fit(docs.limit(0), labels).weights.sum() == 0
