import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import packing
from tidewire.llm.tokens import Encoder, public_path


def check_layout(rows, capacity):
    """Every sequence is gapless from 0 and within the capacity; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_encoder_equals_tokenizer():
    plain = Tokenizer.from_file(public_path())
    texts = ["It's THE end,\n\nof\tall  things 12345 é́ ñ ́x a b\x1cc\x85d", "<|endoftext|> a<|startoftext|>b", "", "x" * 3000, "İΣς ß 'll we'll", " ́a", "日本語 テスト 🙂🙂"]
    got = Encoder(public_path()).encode([*texts, None])
    assert [np.frombuffer(b, "<u4").tolist() for b in got] == [plain.encode(t, add_special_tokens=False).ids for t in texts] + [[]]


def test_best_fit():
    rng = random.Random(1)
    for _ in range(30):
        sizes = np.array([rng.randint(1, 100) for _ in range(rng.randint(0, 200))], np.int64)
        bins, places, fill = packing.best_fit(sizes, 100)
        check_layout([{"sequence_id": b, "offset": p, "length": s} for b, p, s in zip(bins.tolist(), places.tolist(), sizes.tolist())], 100)
        assert len(fill) <= 11 / 9 * max(1, -(-sizes.sum() // 100)) + 4 or (sizes > 50).mean() > 0.4


@pytest.mark.parametrize("parts", [1, 40])
def test_pack(spark, documents, parts):
    rng = random.Random(2)
    texts = [None, "", *[" ".join(rng.choices("alpha beta gamma delta it's 12".split(), k=rng.choice([1, 5, 40, 90, 300]))) for _ in range(300)]]
    docs = documents(*texts).withColumn("fill", F.lit(7)).repartition(parts, "doc_id")
    rows = packing.pack(docs, capacity=128).collect()
    n = check_layout(rows, 128)
    plain, total = Tokenizer.from_file(public_path()), 0
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for d, text in enumerate(texts):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        total += len(ids)
        pieces = sorted(by[d], key=lambda r: r["piece"])
        assert [(r["piece"], r["start"], r["length"]) for r in pieces] == [(k, k * 128, len(ids[k * 128 : k * 128 + 128])) for k in range(-(-len(ids) // 128))]
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) for r in pieces]
    assert n <= 1.05 * -(-total // 128) + 1
    assert packing.pack(docs.limit(0), capacity=128).count() == 0
    twice = packing.pack(docs.union(docs).withColumn("doc_id", F.lit(None).cast("long")), capacity=128).collect()
    assert len(twice) == 2 * len(rows)


def test_large_items_do_not_travel(spark):
    rows = [(k >> 8, (k >> 8 << 32) + k, 70) for k in range(2048)] + [(k, (k << 32) + 9999, 20) for k in range(8)]
    df = spark.createDataFrame(rows, "node long, sequence_id long, fill long")
    up = packing._handed_up(df, 100, 97).collect()
    assert len(up) <= 8 * 9 and sum(r["fill"] == 20 for r in up) == 8
