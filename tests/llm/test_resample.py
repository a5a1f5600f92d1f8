import hashlib
import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import resample


def brute_grams(text):
    words, now = [], ""
    for c in (text or "") + " ":
        low = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if low in "0123456789abcdefghijklmnopqrstuvwxyz" or ord(low) >= 0x80:
            now += low
        else:
            if now:
                words.append(now)
            now = ""
    return words, [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def brute(docs, target, percent=5, least=20):
    size = 10000
    s, t = np.zeros(size, np.int64), np.zeros(size, np.int64)
    grams = [brute_grams(x) for _, x in docs]
    for _, g in grams:
        for x in g:
            s[zlib.crc32(x.encode()) % size] += 1
    for x in target:
        for y in brute_grams(x)[1]:
            t[zlib.crc32(y.encode()) % size] += 1
    gain = [math.floor(1000 * math.log(((t[b] + 1.0) * (t_s + size)) / ((s[b] + 1.0) * (t_t + size)))) for t_s, t_t in [(float(s.sum()), float(t.sum()))] for b in range(size)]
    out = []
    for (d, _), (words, g) in zip(docs, grams):
        weight = sum(gain[zlib.crc32(x.encode()) % size] for x in g)
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(words), len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(able[: len(able) * percent // 100]):
        r[5] = i + 1
    return sorted(map(tuple, out), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_scan_equals_brute_force():
    for text in (None, "", " .,;", "One", "one, TWO", "a b c d e", "Été ß-x\ty 12\x00z", "x" * 100000, "a.b " * 50, "  wide blank"):
        words, grams = brute_grams(text)
        n, codes = resample.scan(text)
        assert n == len(words) and sorted(codes.tolist()) == sorted(zlib.crc32(g.encode()) % 10000 for g in grams)


def test_scan_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 37}" for i in range(500))
    whole = resample.scan(text)
    monkeypatch.setattr(resample, "_MATCHES", 7)
    again = resample.scan(text)
    assert whole[0] == again[0] and (whole[1] == again[1]).all()


def test_documents(spark, documents, monkeypatch):
    texts = [" ".join(f"w{(i * j) % 91}" for j in range(5 + i % 60)) for i in range(300)] + [None, "", "...", "x " * 30000]
    rows = list(enumerate(texts))
    rows += rows[:40] + [(None, texts[50]), (None, None)]
    target = [texts[59], texts[58], None, "Another, one."]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name in ("id", "weight", "rank", "found", "place", "task", "at"):
        docs = docs.withColumn(name, F.lit("own"))
    wanted = spark.createDataFrame([(t, "clash") for t in target], "text string, id string")
    expected = brute(rows, target)
    assert found(resample.resample(docs, wanted)) == expected
    monkeypatch.setattr(resample, "_ROW_BYTES", 1000)
    assert found(resample.resample(docs.repartition(5), wanted)) == expected


def test_empty_sides(spark, documents):
    docs = documents("a b c", None)
    none = docs.limit(0)
    assert resample.resample(none, docs).count() == 0
    assert found(resample.resample(docs, none)) == brute([(0, "a b c"), (1, None)], [])
