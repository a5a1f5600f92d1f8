"""Quality classifier: a linear support vector machine on naive Bayes features.

Features are indicators of n-grams in a text: words and word pairs, and runs of up
to three word shapes (letter case, digits, what punctuation follows, length, whether
the word repeats the one before). They are hashed into 2**BITS places. Indicators are
scaled by the log ratio of their smoothed shares in the two classes; the weights come
from dual coordinate descent on the hinge loss (L2-regularised), and a logistic curve
over the margins of rows kept back makes scores between 0 and 1.

Only the fit is bounded: it takes at most `max_rows` labelled rows, those whose ids
have the smallest hashes, and runs in one task; a smaller set of labels is used
whole. Scoring is one narrow pass over every text, to its end.

Defined results: null and empty texts have no features and get the score of the
model's bias; labels are one per doc_id (the mean of repeated ones, at least one half
is good), null labels and labels of null ids are ignored; of the texts that share a
labelled doc_id the fit takes the first in sorting order; with labels of one class
or none every score is that class's share (0.5 if there are none). Repeated rows
score alike. Other columns are ignored, or kept by `keep_good`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.storage import stage

BITS = 18
_MEMORY = 300_000
_TAIL = re.compile(r"[^\w]*$")


def _shape(token: str) -> int:
    """Letter case, digits, length and trailing punctuation of a token, below 256."""
    tail = _TAIL.search(token).group()
    word = token[: len(token) - len(tail)]
    case = 0 if not word else 1 if word.islower() else 3 if word.isupper() and len(word) > 1 else 2 if word[0].isupper() and (len(word) == 1 or word[1:].islower()) else 4
    punctuation = 0 if not tail else 1 if tail in ".,;:?!" else 2 if len(set(tail)) == 1 and len(tail) > 1 else 3
    length = min(3, len(word) // 4)
    return ((case * 2 + any(c.isdigit() for c in word)) * 4 + punctuation) * 4 + length


class _Tokens(dict):
    """Token: the hash of its letters above eight bits of shape. Bounded; nothing is cut."""

    def __missing__(self, token: str) -> int:
        word = "".join(c for c in token.lower() if c.isalnum())
        value = (xxhash.xxh64_intdigest(word.encode(), 7) & ~0xFF) | _shape(token)
        if len(self) > _MEMORY:
            self.clear()
        self[token] = value
        return value


class Features:
    """Distinct feature places of a text."""

    def __init__(self, bits: int = BITS):
        self._shift = np.uint64(64 - bits)
        self._tokens = _Tokens()
        self._last = np.zeros(1 << bits, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        tokens = text.split() if text else []
        if not tokens:
            return np.zeros(0, np.int64)
        packed = np.fromiter(map(self._tokens.__getitem__, tokens), np.uint64, len(tokens))
        words = packed >> np.uint64(8)
        shapes = packed & np.uint64(0xFF)
        shapes[1:] |= (words[1:] == words[:-1]).astype(np.uint64) << np.uint64(8)
        pairs = words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:] + np.uint64(1)
        two = shapes[:-1] << np.uint64(9) | shapes[1:]
        three = two[:-1] << np.uint64(9) | shapes[2:]
        all_ = np.concatenate([words, pairs, shapes + np.uint64(1 << 57), two + np.uint64(1 << 58), three + np.uint64(1 << 59)])
        all_ ^= all_ >> np.uint64(29)
        places = ((all_ * np.uint64(0xBF58476D1CE4E5B9)) >> self._shift).astype(np.int64)
        order = np.arange(len(places), dtype=np.int32)
        self._last[places] = order
        return places[self._last[places] == order]


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    slope: float
    bias: float

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.bias, -500, 500)))

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum()) / max(1, len(places)) ** 0.5


def fit_rows(rows: list[np.ndarray], labels: np.ndarray, held: np.ndarray, bits: int = BITS, cost: float = 1.0, epochs: int = 12) -> Model:
    """The model of some rows' places; those held are only for the logistic curve."""
    fit = np.flatnonzero(~held)
    good = labels[fit] == 1
    counts = [np.ones(1 << bits), np.ones(1 << bits)]
    for i, yes in zip(fit, good):
        counts[int(yes)][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    scaled = [ratio[x] / max(1, len(x)) ** 0.5 for x in rows]
    weights = np.zeros(1 << bits)
    limit = {1: cost * len(fit) / (2 * max(1, good.sum())), -1: cost * len(fit) / (2 * max(1, (~good).sum()))}
    sides = np.where(labels == 1, 1, -1)
    norms = [float(x @ x) for x in scaled]
    dual = np.zeros(len(rows))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(fit):
            if norms[i] == 0:
                continue
            side = sides[i]
            slope = side * float(weights[rows[i]] @ scaled[i]) - 1
            new = min(max(dual[i] - slope / norms[i], 0.0), limit[int(side)])
            if new != dual[i]:
                weights[rows[i]] += (new - dual[i]) * side * scaled[i]
                moved = max(moved, abs(new - dual[i]))
                dual[i] = new
        if moved < 1e-3:
            break
    model = Model((weights * ratio).astype(np.float32), 1.0, 0.0)
    on = np.flatnonzero(held) if 0 < labels[held].sum() < held.sum() else np.arange(len(rows))
    return Model(model.weights, *_logistic(np.array([model.margin(rows[i]) for i in on]), labels[on]))


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and bias of the logistic curve through the labels, with softened targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x = np.stack([margins, np.ones(len(margins))], 1)
    at = np.array([0.0, np.log((n1 + 1) / (n0 + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        w = np.maximum(p * (1 - p), 1e-9)
        step = np.linalg.solve(x.T @ (x * w[:, None]) + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * at)
        at = at + step * min(1.0, 5 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(float(at[0]), 0.0), float(at[1])


def is_held_out(doc_id):
    """Rows that labels are never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000) -> Model:
    """The model of the labelled documents that are not held out."""
    one = labels.where("quality is not null and doc_id is not null").where(~is_held_out(F.col("doc_id")))
    one = one.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))
    share = one.agg(F.avg("quality")).first()[0]
    if share is None or share in (0, 1):
        share = 0.5 if share is None else float(share)
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    chosen = stage(one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows), "labels")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features(t).astype("<u4").tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({"quality": batch.column("quality"), "held": batch.column("held"), "places": pa.array(found, pa.binary())})

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, labels, held = [], [], []
        for batch in batches:
            rows += [np.frombuffer(b, "<u4").astype(np.int32) for b in batch.column("places").to_pylist()]
            labels.append(batch.column("quality").to_numpy(zero_copy_only=False))
            held.append(batch.column("held").to_numpy(zero_copy_only=False))
        if rows:
            model = fit_rows(rows, np.concatenate(labels), np.concatenate(held))
            yield pa.RecordBatch.from_pydict({"weights": pa.array([model.weights.tobytes()], pa.binary()), "slope": [model.slope], "bias": [model.bias]})

    kept_back = F.pmod(F.xxhash64(F.lit("curve"), "doc_id"), F.lit(5)) == 0
    # at most max_rows rows, so broadcasting them is safe at every size of docs
    labelled = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    # one text per id, so that an id with very many rows does not fill the task of the fit
    labelled = labelled.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("quality").alias("quality"))
    labelled = labelled.select("text", "quality", kept_back.alias("held"))
    coded = labelled.mapInArrow(places, "quality int, held boolean, places binary")
    ordered = coded.repartition(1).sortWithinPartitions("places", "quality")
    row = ordered.mapInArrow(train, "weights binary, slope double, bias double").first()
    if row is None:
        return Model(np.zeros(1 << BITS, np.float32), 0.0, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    return Model(np.frombuffer(row["weights"], np.float32), row["slope"], row["bias"])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every document."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # 2**BITS floats at every size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "score": _scores(batch, features, held.value)})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def keep_good(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with a score of at least one half, in the columns of docs."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            yield batch.filter(pa.array(_scores(batch, features, held.value) >= 0.5))

    return docs.mapInArrow(run, docs.schema)


def _scores(batch: pa.RecordBatch, features: Features, model: Model) -> np.ndarray:
    return model.scores(np.array([model.margin(features(t)) for t in batch.column("text").to_pylist()], np.float64))
