import random

import pytest
from pyspark.sql import functions as F

from tidewire.llm import decontam
from tidewire.llm.words import alnum_words


def brute(text, items, window):
    words, hit, found = alnum_words(text), set(), set()
    for item, body in items:
        own = alnum_words(body)
        size = min(window, len(own))
        grams = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in grams:
                hit |= set(range(i, i + size))
                found.add(item)
    return len(words), hit, sorted(found)


@pytest.mark.parametrize("window", [3, 10])
def test_automaton_equals_brute_force(window):
    rng = random.Random(window)
    for _ in range(150):
        letters = "abc" if rng.random() < 0.5 else "abcdefgh"
        items = [(str(k), " ".join(rng.choices(letters, k=rng.choice([0, 1, 2, 5, 14, 30])))) for k in range(rng.randint(0, 6))]
        machine = decontam.Automaton([(k, alnum_words(t)) for k, t in items], window)
        for _ in range(4):
            text = " ".join(rng.choices(letters, k=rng.randint(0, 40)) + (items[0][1].split() if items else []))
            n, hit, found = brute(text, items, window)
            spans, got = machine.scan(alnum_words(text))
            assert (sorted(got), {i for a, b in spans for i in range(a, b + 1)}, n) == (found, hit, len(alnum_words(text)))


def test_edge_rows(spark, documents):
    item = "one two three four five six seven eight nine ten eleven"
    docs = documents(None, "", "x " + item.upper() + " y", "x " + item.upper() + " y", "é " * 50000, "tiny words here").withColumn("hits", F.lit(1))
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny words"), (None, item)], "item_id long, text string")
    rows = sorted(decontam.find_contamination(docs, bench).collect(), key=lambda r: r["doc_id"])
    assert [(r["n_words"], [tuple(x) for x in r["hits"]], r["items"]) for r in rows] == [
        (0, [], []), (0, [], []), (13, [(1, 11)], ["", "1"]), (13, [(1, 11)], ["", "1"]), (50000, [], []), (3, [(0, 1)], ["4"]),
    ]
    assert decontam.find_contamination(docs.limit(0), bench).count() == 0
    assert all(r["items"] == [] for r in decontam.find_contamination(docs, bench.limit(0)).collect())


def test_several_automata(spark, documents, monkeypatch):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(30)]
    docs = documents(*[f"head {t} tail " + items[(k + 1) % 30][1] for k, t in items])
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = {r["doc_id"]: (r["hits"], r["items"]) for r in decontam.find_contamination(docs, bench).collect()}
    monkeypatch.setattr(decontam, "AUTOMATON_WORDS", 300)
    assert {r["doc_id"]: (r["hits"], r["items"]) for r in decontam.find_contamination(docs, bench).collect()} == whole


def test_removal(spark, documents):
    item = "one two three four five six seven eight nine ten"
    rest = " ".join(f"w{i}" for i in range(30))
    docs = documents(f"{rest} {item}! {rest}", f"a {item}", "clean text", None).withColumn("keep", F.lit("k"))
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontam.remove_contamination(docs, bench).collect()}
    assert sorted(rows) == [0, 2, 3]
    assert rows[0]["text"] == f"{rest} ! {rest}" and rows[0]["n_chars"] == len(rows[0]["text"])
    assert rows[2]["text"] == "clean text" and rows[3]["text"] is None and rows[2]["keep"] == "k"


def test_removal_does_not_depend_on_the_number_of_automata(spark, documents, monkeypatch):
    items = [(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(12)]
    rest = " ".join(f"r{i}" for i in range(15))
    texts = [f"{rest} {items[k][1]} {items[(k + 1 + k % 5) % 12][1]}" for k in range(12)] + [f"{rest} {rest} {t}" for _, t in items] + [None, ""]
    docs = documents(*texts).withColumn("hits", F.lit("own")).withColumn("row", F.lit(1))
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, decontam.remove_contamination(docs, bench).collect()))
    assert 12 <= len(whole) < len(texts)
    for words in (100, 20):
        monkeypatch.setattr(decontam, "AUTOMATON_WORDS", words)
        assert len(list(decontam.automata(bench, 10))) > 1
        assert sorted(map(tuple, decontam.remove_contamination(docs, bench).collect())) == whole
