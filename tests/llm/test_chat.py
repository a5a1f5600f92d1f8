import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from tidewire.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def random_model(rng):
    logs = lambda *shape: np.log(rng.dirichlet(np.ones(shape[-1]), shape[:-1] or None))
    return chat.Model(logs(3), logs(3, 3), logs(3, chat._FEATURES))


def brute(model, texts):
    seen = [model.seen(t) for t in texts]
    def total(states):
        return model.start[states[0]] + sum(model.move[a, b] for a, b in zip(states, states[1:])) + sum(s[x] for s, x in zip(seen, states))
    return list(max(itertools.product(range(3), repeat=len(texts)), key=total))


def test_viterbi_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(40):
        model = random_model(rng)
        texts = ["x" * int(rng.integers(0, 200)) + "\ny?" * int(rng.integers(0, 3)) for _ in range(int(rng.integers(1, 7)))]
        seen = np.array([model.seen(t) for t in texts])
        assert chat.path(model, seen, None, None) == brute(model, texts)


def test_blocks_change_nothing(spark, monkeypatch):
    rng = random.Random(8)
    model = random_model(np.random.default_rng(9))
    rows = [(c, t, None, "w" * rng.randint(0, 90) + "\nend?" * rng.randint(0, 2)) for c in range(6) for t in range(rng.choice([1, 4, 30]))]
    turns = spark.createDataFrame(rows, TURNS)
    found = {}
    for size in (512, 3):
        monkeypatch.setattr(chat, "TURNS", size)
        found[size] = sorted((r["conv_id"], r["turn"], r["role"]) for r in chat.recover(turns, model).collect())
    assert found[3] == found[512] and len(found[3]) == len(rows)
    for c in range(6):
        texts = [t for x, _, _, t in rows if x == c]
        states = chat.path(model, np.array([model.seen(t) for t in texts]), None, None)
        assert [r for x, _, r in found[3] if x == c] == [chat.ROLES[s] for s in states]


def test_held_out_accuracy(spark):
    turns = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    held = F.crc32(F.col("conv_id").cast("string")) % 3 == 1
    model = chat.fit(turns.where(~held))
    rows = chat.recover(turns.where(held), model).collect()
    assert sum(r["role"] == r["given_role"] for r in rows) / len(rows) > 0.98


def test_counts_follow_the_rows(spark):
    turns = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "Assistant ", "b"), (1, 2, "user", "c"), (2, 0, "user", "d"), (2, 1, "narrator", "e"), (3, 0, None, "f")], TURNS)
    model = chat.fit(turns)
    assert np.allclose(np.exp(model.start), [1 / 5, 3 / 5, 1 / 5])
    assert np.allclose(np.exp(model.move[1]), [1 / 4, 1 / 4, 2 / 4]) and np.allclose(np.exp(model.move[2]), [1 / 4, 2 / 4, 1 / 4])


def test_markers_and_rendering():
    for text, role, rest in [("User: hi", "user", "hi"), ("### Assistant:\nyes", "assistant", "yes"), ("<|im_start|>system\nbe kind", "system", "be kind"), ("[Human] hm", "user", "hm"), ("A: b", "assistant", "b"), ("**Bot:** ok", "assistant", "ok")]:
        assert chat.marker(text)[0] == role and chat.render(role, text) == f"<|im_start|>{role}\n{rest}<|im_end|>\n"
    for text in ("", "A dog: no", "user friendly", "apple", "Assistants: x"):
        assert chat.marker(text) == (None, 0), text


def test_edges(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, "user", None), (1, 2, None, ""), (1, 2, None, ""), (2, 5, "x", "y" * 200000)]
    turns = spark.createDataFrame(rows, TURNS).withColumn("conv", F.lit("clash")).withColumn("block", F.lit(1))
    model = chat.fit(turns)
    found = chat.recover(turns, model).collect()
    assert len(found) == 6 and all(r["role"] in chat.ROLES for r in found)
    assert chat.recover(turns.limit(0), chat.fit(turns.limit(0))).count() == 0
