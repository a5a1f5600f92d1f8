import random

import numpy as np
import xxhash

from tidewire.llm import simhash
from tidewire.llm.components import components
from pyspark.sql import functions as F


def brute_print(text, k=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, now = [], ""
    for c in lower + " ":
        if c == " " or "\t" <= c <= "\r":
            if now:
                words.append(now)
            now = ""
        else:
            now += c
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(values, bits):
    root = {v: v for v in values}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= bits:
                ra, rb = sorted((find(a), find(b)))
                root[rb] = ra
    return {v: find(v) for v in values}


def clustered(rng, n, centres):
    out = set()
    while len(out) < n:
        x = rng.choice(centres)
        for _ in range(rng.randint(0, 6)):
            x ^= 1 << rng.randrange(64)
        out.add(x)
    return sorted(out)


def test_fingerprints(spark):
    for text in (None, "", " \n", "One", "one TWO", "a\x0bb c d É e " * 40, "Été ß  x\ty"):
        assert simhash.fingerprint(text, 3) % (1 << 64) == brute_print(text)
    x = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first()["h"]
    assert simhash.fingerprint("A b  c", 3) == x


def test_forest_connects_what_brute_force_connects():
    rng = random.Random(5)
    values = clustered(rng, 3000, [rng.getrandbits(64) for _ in range(200)])
    points = [rng.getrandbits(64) for _ in range(4)]
    a, b = simhash.forest(np.array(values, np.uint64), len(values), points, 3)
    assert len(a) < len(values)
    assert all((x in set(values)) for x in a.tolist())
    expected = brute_roots(values, 3)
    root = {v: v for v in values}
    for x, y in zip(a.tolist(), b.tolist()):
        root[x] = y
    groups = {}
    for v in values:
        groups.setdefault(root[v], set()).add(v)
    wanted = {}
    for v in values:
        wanted.setdefault(expected[v], set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, wanted.values()))


def test_shards_lose_no_link(spark, monkeypatch):
    rng = random.Random(6)
    values = clustered(rng, 1200, [rng.getrandbits(64) for _ in range(60)])
    signed = [simhash._signed(v) for v in values]
    expected = brute_roots(values, 3)
    for limit in (40_000, 40):
        monkeypatch.setattr(simhash, "SHARD_LIMIT", limit)
        found = components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"))).collect()
        root = {r["node"]: r["root"] for r in found}
        same = {}
        for v, s in zip(values, signed):
            same.setdefault(root.get(s, s), set()).add(expected[v])
        assert all(len(x) == 1 for x in same.values()) and len(same) == len(set(expected.values()))


def test_documents(spark, documents):
    base = " ".join(f"w{i}" for i in range(300))
    docs = documents(base, base, base + " tail", "other words here", None, "", "x " * 50000).withColumn("fp", F.lit("clash"))
    rows = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    values = sorted({r["fp"] % (1 << 64) for r in rows.values()})
    expected = brute_roots(values, 3)
    for r in rows.values():
        mine = [d for d, o in rows.items() if expected[o["fp"] % (1 << 64)] == expected[r["fp"] % (1 << 64)]]
        assert r["component_id"] == min(mine)
    assert rows[1]["component_id"] == 0 and rows[5]["component_id"] == 4 and rows[4]["fp"] == 0
    kept = simhash.keep_one(docs.union(docs)).collect()
    assert sorted(r["doc_id"] for r in kept) == sorted({r["component_id"] for r in rows.values()})
    assert kept[0]["fp"] == "clash"
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_different_texts_of_one_id(spark, documents):
    one, two, three = (" ".join(f"{x}{i}" for i in range(80)) for x in "abc")
    docs = documents(one, two, three, None).withColumn("root", F.lit("clash"))
    again = docs.where("doc_id in (1, 2)").withColumn("doc_id", F.when(F.col("doc_id") == 1, 0).otherwise(2).cast("long"))
    nobody = docs.limit(1).withColumn("doc_id", F.lit(None).cast("long"))
    copies = docs.where("doc_id = 0").withColumn("doc_id", F.lit(3).cast("long"))
    kept = simhash.keep_one(docs.union(again).union(nobody).union(copies))
    assert kept.columns == docs.columns
    # 0: two texts, two groups; 1 and 3 are copies of texts of 0, but 3 has an own (empty) text too
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([(0, one), (0, two), (2, three), (3, None), (None, one)], key=str)


def test_components_of_a_path(spark):
    n = 400
    path = spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long")
    assert {r["root"] for r in components(path).collect()} == {0}
