import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import licenses
from tidewire.llm.words import alnum_words


def brute_align(a, b):
    """Smith-Waterman without a band: the best score and its number of matches."""
    table = [[(0, 0)] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = (0, 0)
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            s, m = table[i][j]
            options = [(s + 2, m + 1)] if x == y else [(s - 1, m), *[(t - 1, n) for t, n in (table[i][j + 1], table[i + 1][j])]]
            table[i + 1][j + 1] = max([*options, (0, 0)], key=lambda c: c[0])
            best = max(best, table[i + 1][j + 1], key=lambda c: c[0])
    return best


def test_alignment_equals_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        a = [bytes([rng.choice(b"abcdefg")]) for _ in range(rng.randint(3, 14))]
        b = [w for w in a if rng.random() > 0.1]
        b = [w if rng.random() > 0.15 else b"z" for w in b]
        matched, first, last = licenses.align(a, b, -20, 20)
        score, _ = brute_align(a, b)
        assert 2 * matched >= score and (matched == 0 or 0 <= first <= last < len(b))
        if a == b:
            assert (matched, first, last) == (len(a), 0, len(a) - 1)


def test_winnowing_keeps_one_of_every_window():
    rng = np.random.default_rng(1)
    for n in (1, 3, 4, 50):
        grams = rng.integers(0, 9, n).astype(np.uint64)
        kept = licenses.winnow(grams, 4)
        assert kept == sorted(set(kept)) and all(set(range(i, i + 4)) & set(kept) for i in range(n - 3))


def test_templates_are_found_where_they_stand(spark, documents):
    rng = random.Random(3)
    noise = lambda n: " ".join(f"w{rng.randrange(999)}" for _ in range(n))
    texts, wanted = [], {}
    for d, (name, body) in enumerate(licenses.TEMPLATES.items()):
        words = body.split()
        if len(words) > 30:
            words[10:12] = ["changed"]
        head = noise(rng.randint(0, 40)) + " é🙂 "
        texts.append(head + " ".join(words) + "\n" + noise(20))
        wanted[d] = (name, len(head), len(head) + len(" ".join(words).rstrip("/.")))
    texts += [None, "", noise(3000), "the software license is", "x " * 90000]
    docs = documents(*texts).withColumn("template", F.lit("clash"))
    rows = licenses.scan(docs.union(docs)).collect()
    for d, (name, start, end) in wanted.items():
        mine = [r for r in rows if r["doc_id"] == d and r["template"] == name]
        assert len(mine) == 2 and mine[0]["coverage"] >= 0.9 and abs(mine[0]["start"] - start) <= 1 and abs(mine[0]["end"] - end) <= 1
    assert {r["doc_id"] for r in rows} == set(wanted)
    assert licenses.scan(docs.limit(0)).count() == 0 and licenses.scan(docs, {}).count() == 0


def test_repeated_matches_and_half_matches(spark, documents):
    mit = licenses.TEMPLATES["MIT"]
    half = " ".join(mit.split()[: len(alnum_words(mit)) // 2])
    rows = licenses.scan(documents(f"{mit} between words {mit}", half)).collect()
    assert [(r["doc_id"], r["template"], r["coverage"]) for r in rows] == [(0, "MIT", 1.0)] * 2
    assert licenses.scan(documents(half), coverage=0.4).first()["coverage"] > 0.4


def test_overlaps_whatever_the_number_of_matches(spark, documents):
    words = [f"t{i}" for i in range(40)]
    index = licenses.Index({"one": " ".join(words)})
    known = licenses._Hashes()

    def scan(text):
        found = text.split()
        found = [w.encode() for w in found]
        return index.scan(found, np.array([known[w] for w in found], np.uint64), 0.5)

    twice = " ".join(words + words[20:])
    alone = scan(twice)
    many = scan(" ".join([twice, *[" ".join(["gap"] * 60 + words)] * 100]))
    assert many[: len(alone)] == alone and len(many) == len(alone) + 100
    spans = sorted((m.first, m.last) for m in many)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
