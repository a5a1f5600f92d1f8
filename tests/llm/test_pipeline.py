"""The corpus pipeline against its five stages done one document at a time."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from conftest import DOCS
from test_decontam import brute as hit_words
from test_packing import check_layout
from test_pii import brute as entities
from test_simhash import brute_print, brute_roots
from tidewire.llm import pii, quality
from tidewire.llm.tokens import public_path
from tidewire.llm.words import ALNUM_WORD


@pytest.fixture()
def corpus(spark, tmp_path):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(400)]
    item = " ".join(vocabulary[:14])

    def prose(n):
        return " ".join(rng.choices(vocabulary, k=n)) + "."

    good = [prose(rng.randint(60, 200)) for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choices(vocabulary, k=rng.randint(60, 200))) for _ in range(30)]
    long = prose(4500)
    planted = [good[3], good[3], long, long.replace(" ", "  ", 5), long + " more", f"{good[5]} {item.upper()} {prose(80)}", f"{prose(10)} {item}",
               f"{prose(70)} ann@corp.example {prose(70)}", f"{prose(70)} 10.1.2.3 {prose(70)}", f"{prose(60)} +1 (555) 010-2345 {prose(9)}", bad[2]]
    texts = [*good, *bad, *planted]
    rows = [(1000 - i, t, "en", "src0", len(t)) for i, t in enumerate(texts)]
    labels = [(1000 - i, int(i < len(good))) for i in range(len(good) + len(bad))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([("q1", item), ("q2", None)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path), {r[0]: r[1] for r in rows}, [("q1", item)]


def cut(text, hit):
    """The text without its hit words; neighbouring ones go with what is between them."""
    out, at, places = "", 0, [m.span() for m in ALNUM_WORD.finditer(text)]
    for i in sorted(hit):
        if i - 1 not in hit:
            out += text[at : places[i][0]]
        at = places[i][1]
    return out + text[at:]


def test_run_equals_stages_by_hand(spark, corpus):
    sf_dir, texts, items = corpus
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    features = quality.Features()
    kept = {i: t for i, t in texts.items() if model.scores(np.array([model.margin(features(t))]))[0] >= 0.5}
    assert 60 <= len(kept) < len(texts) - 25

    prints = {i: brute_print(t) for i, t in kept.items()}
    roots = brute_roots(sorted(set(prints.values())), 3)
    groups = {}
    for i, p in prints.items():
        groups.setdefault(roots[p], []).append(i)
    single = {min(g): kept[min(g)] for g in groups.values()}
    assert len(kept) - len(single) >= 4

    clean = {}
    for i, text in single.items():
        n, hit, _ = hit_words(text, items, 10)
        if not hit:
            clean[i] = text
        elif len(hit) <= n / 2:
            clean[i] = cut(text, hit)
    assert len(clean) == len(single) - 1 and clean != {i: single[i] for i in clean}

    stage = spark.createDataFrame([(i, t) for i, t in clean.items()], "doc_id long, text string")
    assert pii.disclosing_terms(stage.select("text")).isEmpty()
    for i, text in clean.items():
        for kind, start, end, _ in sorted(entities(text), key=lambda x: -x[1]):
            text = text[:start] + pii.PLACEHOLDERS[kind] + text[end:]
        clean[i] = text
    assert sum("[EMAIL]" in t or "[IP]" in t or "[PHONE]" in t for t in clean.values()) == 3

    plain = Tokenizer.from_file(public_path())
    expected = []
    for i, text in clean.items():
        ids = np.array([*plain.encode(text, add_special_tokens=False).ids, 1], "<u4")
        expected += [(i, k, k * 4096, len(p), zlib.crc32(p.tobytes())) for k, p in enumerate(np.split(ids, range(4096, len(ids), 4096)))]
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(expected)
    assert check_layout(rows, 4096) <= -(-sum(e[3] for e in expected) // 4096) + 1


def test_stages_keep_the_columns_and_empty_tables(spark, corpus):
    sf_dir = corpus[0]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("score", F.lit("clash"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).columns == docs.columns, name
        assert stage(spark, docs.limit(0), sf_dir).isEmpty(), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), sf_dir).isEmpty()
