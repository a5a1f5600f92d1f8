import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import minmax


def brute_set(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lower = lower.replace(c, " ")
    words = [w for w in lower.split(" ") if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) or frozenset([tuple(words)])


def brute(rows, percent=85):
    """[(doc_id, n_shingles, component_id)] of rows (doc_id, text)."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((d, len(sets[i]), min(ids, default=None)))
    return sorted(out, key=str)


def alone(rows):
    """Texts without words are linked with nothing: their component is their own doc_id."""
    return sorted(((d, n, d if n == 0 else c) for d, n, c in rows), key=str)


def found(df):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in df.collect()), key=str)


def drifting(rng, n, words=60, vocabulary=400):
    """Texts that each change a word or two of an earlier one, so that similarity fades along chains."""
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.9:
            base = rng.choice(texts).split(" ")
            for _ in range(rng.randint(1, 2)):
                base[rng.randrange(len(base))] = f"w{rng.randrange(vocabulary)}"
        else:
            base = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
        texts.append(" ".join(base))
    return texts


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(3)
    common, mine, yours = (rng.integers(0, 1 << 63, n, np.uint64) for n in (800, 100, 100))
    sets = [np.sort(np.concatenate([common, mine])), np.sort(np.concatenate([common, yours])), mine]
    low, high = minmax.extremes(sets)
    for i, s in enumerate(sets):
        permuted = s[:, None] * minmax._FACTORS + minmax._SHIFTS
        assert (low[i] == permuted.min(0)).all() and (high[i] == permuted.max(0)).all()
    agreed = np.mean([(low[0] == low[1]).mean(), (high[0] == high[1]).mean()])
    assert abs(agreed - 0.8) < 0.2
    assert minmax.missed(0.85) < 1e-7


def test_sets_larger_than_a_chunk(monkeypatch):
    rng = np.random.default_rng(4)
    sets = [np.sort(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 70, 5, 300, 2)]
    whole = minmax.extremes(sets)
    monkeypatch.setattr(minmax, "_CHUNK", 7)
    for a, b in zip(whole, minmax.extremes(sets)):
        assert (a == b).all()


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(5)
    for n in (1, 2, 31, 33, 64, 65, 700, 5000):
        one = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for share in (0.0, 0.05, 0.2, 0.6):
            two = np.unique(np.concatenate([one[rng.random(len(one)) >= share], rng.integers(0, 1 << 63, int(n * share / 3), np.uint64)]))
            alone = len(np.setxor1d(one, two))
            differ = minmax.apart(minmax.sketch(one)[None, :], minmax.sketch(two)[None, :])
            assert differ[0] <= alone and (n < 600 or share != 0.05 or differ[0] > 0.7 * alone)
            if 100 * (len(one) + len(two) - alone) >= 85 * (len(one) + len(two) + alone):
                assert minmax.allowed(differ, np.array([len(one) + len(two)]), 85)[0]


def test_chains_equal_brute_force(spark, documents, monkeypatch):
    texts = drifting(random.Random(8), 260)
    expected = brute(list(enumerate(texts)))
    for part, leaders in ((2048, 2), (7, 1)):
        monkeypatch.setattr(minmax, "PART", part)
        monkeypatch.setattr(minmax, "LEADERS", leaders)
        assert found(minmax.near_duplicates(documents(*texts))) == expected


def test_defined_results(spark, documents):
    base = " ".join(f"w{i}" for i in range(100))
    texts = [base, base.upper(), base + " tail", base + " other tail and more words", None, None, "", " \t\n", "one", "One two", "one\x0btwo", "a b c", "c b a", "x " * 60000]
    docs = documents(*texts)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    again = rows + rows[:3] + [(None, base), (None, "nobody"), (0, "of the same id but another text"), (4, "not null here")]
    schema = "doc_id long, text string"
    clash = spark.createDataFrame(again, schema)
    for name in ("node", "root", "n", "digest", "bands", "bucket", "text_hash", "component_id"):
        clash = clash.withColumn(name, F.lit("own"))
    assert found(minmax.near_duplicates(clash)) == alone(brute(again))
    assert minmax.near_duplicates(docs.limit(0)).count() == 0
