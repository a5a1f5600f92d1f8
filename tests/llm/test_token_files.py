import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewire.llm import token_files
from tidewire.llm.tokens import public_path
from tidewire.plans.storage import shared_path


def brute(ids, end):
    out, now = [], 0
    for x in ids:
        if x == end:
            out.append((now, True))
            now = 0
        else:
            now += 1
    return out + ([(now, False)] if now else [])


@pytest.mark.parametrize("block", [1, 2, 7, 1000])
def test_scan_equals_brute_force(spark, block):
    rng = np.random.default_rng(block)
    files = {f"f{k}": np.where(rng.random(n) < p, 9, rng.integers(0, 9, n)).astype(">u2") for k, (n, p) in enumerate([(0, 0), (1, 1), (60, 0.2), (60, 0.02), (61, 0.0), (40, 0.9), (33, 0.3)])}
    rows = [(f, b, bytearray(x[at : at + block].tobytes())) for f, x in files.items() for b, at in enumerate(range(0, len(x), block))]
    found = token_files.scan(spark.createDataFrame(rows, "file string, block long, ids binary"), end=9).collect()
    for f, x in files.items():
        got = sorted((r["place"], r["n_tokens"], r["ended"]) for r in found if r["file"] == f)
        assert got == [(k, n, e) for k, (n, e) in enumerate(brute(x.tolist(), 9))]


def test_counts(spark, documents):
    plain = Tokenizer.from_file(public_path())
    plain.encode_special_tokens = True
    texts = [None, "", "One small text", "it's <|endoftext|> again", "w " * 60000, *[f"text number {i}" for i in range(200)]]
    docs = documents(*texts, *texts).withColumn("place", F.lit("clash"))
    path = shared_path(spark, "docs")
    docs.write.parquet(path)
    docs = spark.read.parquet(path)
    for block in (5, 1 << 18):
        rows = token_files.counts(docs, block=block).collect()
        assert len(rows) == 2 * len(texts)
        both = texts + texts
        assert all(r["n_tokens"] == len(plain.encode(both[r["doc_id"]] or "", add_special_tokens=False).ids) for r in rows)
    assert token_files.counts(docs.limit(0)).count() == 0


def test_files_are_flat_ids(spark, documents):
    path = shared_path(spark, "flat")
    token_files.write(documents("One small text", None).coalesce(1), path)
    content = spark.read.format("binaryFile").load(path + "/part-*").collect()
    ids = np.frombuffer(b"".join(r["content"] for r in content), ">u2").tolist()
    plain = Tokenizer.from_file(public_path())
    assert ids == plain.encode("One small text", add_special_tokens=False).ids + [token_files.END, token_files.END]
    with pytest.raises(UnicodeDecodeError):
        token_files.write(documents("a"), path, end=0xFFC0)


def test_files_are_cut_and_scanned_by_one_worker(spark, monkeypatch):
    path = shared_path(spark, "flat")
    token_files.write(spark.createDataFrame([(f"one two three {n} " * n,) for n in range(40)], "text string").repartition(3), path)
    two_steps = sorted(map(tuple, token_files.scan(token_files.blocks(spark, path, 16)).collect()))
    plans = []
    kept = token_files.stage
    monkeypatch.setattr(token_files, "stage", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), kept(df, name))[1])
    assert sorted(map(tuple, token_files.scan_files(spark, path, 16).collect())) == two_steps and len(two_steps) == 40
    assert plans[0].count("MapInArrow") == 1


def test_new_pieces_go_to_the_tokenizer_in_parts(monkeypatch):
    from tidewire.llm import tokens

    texts = [" ".join(f"Word{n}x{k} plain{'abc'[k % 3]} é{k}." for k in range(50)) for n in range(20)]
    whole = tokens.Encoder(tokens.public_path()).encode(texts)
    monkeypatch.setattr(tokens, "_AT_ONCE", 7)
    coder, sizes = tokens.Encoder(tokens.public_path()), []
    for name in ("_ids", "_word_ids"):
        kept = getattr(coder, name)
        monkeypatch.setattr(coder, name, lambda pieces, kept=kept: (sizes.append(len(pieces)), kept(pieces))[1])
    assert coder.encode(texts) == whole and max(sizes) <= 7
