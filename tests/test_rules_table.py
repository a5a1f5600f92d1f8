"""Rules in a table: equal to the chain of conditions, at a cost that does not grow with them."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.functions.globs import to_regex
from tidewire.operators import rules as R
from tidewire.operators.select import first_match_rule, log_name_matches

ALPHABET = "ab.-/[]!*é"


def pattern(rng):
    out = "".join(rng.choice(["a", "b", ".", "*", "?", "[ab]", "[!a]", "[a-b.]", "[]a]", "[", "]", "\\", "é", "^"]) for _ in range(rng.randint(0, 6)))
    return rng.choice([out, out + "*", "*" + out])


def name(rng):
    return "".join(rng.choice("aabb..[]\\^é\n") for _ in range(rng.randint(0, 7)))


def test_trie_equals_the_globs_one_by_one():
    rng = random.Random(1)
    for _ in range(60):
        rules = [(pattern(rng), pattern(rng)) for _ in range(rng.choice([1, 5, 40]))]
        trie = R.RuleTrie(R.glob_tokens)
        for n in sorted(range(len(rules)), key=lambda _: rng.random()):
            trie.add(rules[n], n)
        compiled = [tuple(re.compile(to_regex(p).replace("\\z", "\\Z")) for p in rule) for rule in rules]
        for _ in range(60):
            fields = (name(rng), name(rng))
            expected = next((n for n, (a, b) in enumerate(compiled) if a.match(fields[0]) and b.match(fields[1])), None)
            assert trie.first(fields) == expected, (rules, fields)


def test_a_step_does_not_cost_by_the_number_of_rules():
    widest = {}
    for n in (100, 10_000):
        trie = R.RuleTrie(R.glob_tokens)
        for k in range(n):
            trie.add((f"transport.f{k}.*", f"*-{k}.dat"), k)
        trie.add(("*", "*.txt"), n)
        rng = random.Random(2)
        for _ in range(200):
            k = rng.randrange(n)
            assert trie.first((f"transport.f{k}.x", f"y-{k}.dat")) == k
            assert trie.first((f"transport.f{k}.x", f"y-{k}.txt")) == n
            assert trie.first((f"transport.f{k}.x", "y.dat")) is None
        widest[n] = max(len(alive) for alive, _ in trie.steps)
    assert widest[100] == widest[10_000] < 10


def test_first_rule_equals_the_chain(spark):
    rng = random.Random(3)
    listed = [(pattern(rng), pattern(rng), f"t{n}") for n in range(80)]
    rules = spark.createDataFrame([(10 * n, *r) for n, r in enumerate(listed)] + [(-1, None, "*", "no"), (None, "*", "*", "no")], "rule_no int, feed string, name string, template string")
    rows = [(name(rng), name(rng), n) for n in range(500)] + [(None, "a", 500), ("a", None, 501), ("a", "a", 502), ("a", "a", 503)]
    files = spark.createDataFrame(rows, "newsgroup string, filename string, n int")
    both = files.select("n", F.coalesce(R.first_rule(rules.repartition(3)), F.lit("")).alias("a"), first_match_rule(files, listed).alias("b"))
    assert [(r.n, r.a) for r in both.collect()] == [(r.n, r.b) for r in both.collect()]
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "ArrowEvalPython" in plan


def test_log_rules(spark):
    given = ["!Group1/worker/*", "Group1/**", "*/error", "a*b", "**x", "!**"]
    rules = spark.createDataFrame([(n, p.removeprefix("!"), not p.startswith("!")) for n, p in enumerate(given)], "rule_no int, pattern string, keep boolean")
    names = ["Group1/worker/a", "Group1/worker/", "Group1/worker/a/b", "Group1/", "Group1", "Group2/error", "/error", "a/b", "ab", "acb", "a/x", "x", "a\nx", "a x", "b c/error", "", None]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = df.select("name", R.log_rule(rules, F.col("name")).alias("a"), F.coalesce(log_name_matches(F.col("name"), given), F.lit(False)).alias("b")).collect()
    assert [(r["name"], r.a) for r in got] == [(r["name"], r.b) for r in got]


def test_size_is_checked(spark, monkeypatch):
    monkeypatch.setattr(R, "MAX_RULE_BYTES", 100)
    rules = spark.createDataFrame([(n, "*", "*", "t") for n in range(9)], "rule_no int, feed string, name string, template string")
    with pytest.raises(ValueError, match="at most 100"):
        R.first_rule(rules)
    assert spark.createDataFrame([("a", "b")], "newsgroup string, filename string").select(R.first_rule(rules.limit(0)).alias("r")).first().r is None


def test_rules_met_by_joins_equal_the_trie(spark, monkeypatch):
    rng = random.Random(4)
    rules = [(n // 2, pattern(rng), pattern(rng), None if n % 9 == 0 else f"t{n}") for n in range(150)]
    rules = spark.createDataFrame([*rules, (-1, None, "*", "no"), (None, "*", "*", "no"), (-1, "a*", "", "x")], "rule_no int, feed string, name string, template string")
    rows = [(name(rng), name(rng), n) for n in range(400)] + [(None, "a", 500), ("a", None, 501), ("a", "a", 502), ("a", "a", 502), ("a\0", "b", 503), ("ab", "", 504)]
    files = spark.createDataFrame(rows, "newsgroup string, filename string, n int")
    expected = files.select("n", R.first_rule(rules).alias("template"))
    monkeypatch.setattr(R, "MAX_RULE_BYTES", 100)  # holds for what goes to every task
    got = R.match_first_rule(files, rules).select("n", "template")
    assert sorted(map(repr, got.collect())) == sorted(map(repr, expected.collect()))
    assert len({r.template for r in got.collect()}) > 10
