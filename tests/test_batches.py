"""The batching rule: closed forms, segments and carried state against a plain loop."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import batches as B
from tidewire.operators import merge as G

START = datetime(2024, 1, 1)
SCHEMA = "newsgroup string, article_number bigint, msg_time timestamp_ntz, n_bytes bigint, has boolean"


def feed(seed, ordered=False):
    rng = random.Random(seed)
    out = []
    for group in ("a", "b"):
        t = 0
        for article in range(1, 120):
            t += rng.choice([0, 10, 30, 60, 200])
            late = 0 if ordered else rng.choice([0, 0, 0, 90, 250])
            out.append((group, article, START + timedelta(seconds=t - late), 1, rng.random() < 0.8))
    return out


def loop(rows, gap, span, limit, low=None, high=None, with_files=False):
    """The rule as SURVEY section 2.6 states it, one message after the other."""
    result = {}
    state = {}
    for group, article, when, _, has in rows:
        t = (when - START).total_seconds() + 86400 * 19723
        n, last, batch = state.get(group, (0, None, None))
        if (low and when < low) or (high and when > high):
            state[group] = (0, t, None)
            result[group, article] = ("out_of_range", None)
            continue
        if gap and last is not None and t - last >= gap:
            n, last = 0, t
        if span and last is not None:
            if t // span == last // span:
                if limit and n >= limit:
                    state[group] = (n, last, batch)
                    result[group, article] = ("rejected", None)
                    continue
            else:
                n, last = 0, t
        if with_files and not has:
            state[group] = (n, last, batch)
            result[group, article] = ("skipped", None)
            continue
        if n == 0:
            batch = article
        n, last = n + 1, t
        result[group, article] = ("saved", batch)
        if limit and n >= limit and not span and not gap:
            n = 0
        state[group] = (n, last, batch)
    return result


def canonical(result):
    """Batches by their members, whatever their ids are."""
    batches = {}
    for (group, article), (action, batch) in result.items():
        if action == "saved":
            batches.setdefault((group, batch), []).append(article)
    return sorted((g, tuple(sorted(m))) for (g, _), m in batches.items()), sorted(
        (k, a) for k, (a, _) in result.items()
    )


def collected(df):
    return {(r.newsgroup, r.article_number): (r.action, r.batch_id) for r in df.collect()}


CASES = [
    dict(gap=100), dict(span=300), dict(max_messages=7), dict(gap=60, span=300), dict(span=300, max_messages=3),
    dict(gap=60, max_messages=3), dict(gap=60, span=300, max_messages=2),
]


@pytest.mark.parametrize("options", CASES, ids=str)
@pytest.mark.parametrize("bounded", [False, True])
@pytest.mark.parametrize("with_files", [False, True])
def test_batch_feed_equals_loop(spark, options, bounded, with_files):
    rows = feed(len(str(options)) + bounded)
    low, high = (START + timedelta(seconds=700), START + timedelta(seconds=5000)) if bounded else (None, None)
    opts = B.BatchOptions(**options, start=str(low) if low else None, stop=str(high) if high else None)
    df = spark.createDataFrame(rows, SCHEMA)
    expected = canonical(
        loop(rows, options.get("gap", 0), options.get("span", 0), options.get("max_messages", 0), low, high, with_files)
    )
    has = F.col("has") if with_files else None
    assert canonical(collected(B.batch_feed(df, opts, has, block_size=16))) == expected


def test_carried_state_goes_on(spark):
    rows = feed(5)
    options = B.BatchOptions(gap=60, span=300, max_messages=2)
    first = spark.createDataFrame([r for r in rows if r[1] <= 50], SCHEMA)
    second = spark.createDataFrame([r for r in rows if r[1] > 50], SCHEMA)
    none = spark.createDataFrame([], "newsgroup string, batch_id bigint, n bigint, last bigint")
    one = B.batch_feed(first, options, carried=none, block_size=16)
    state = one.groupBy("newsgroup").agg(F.max_by(F.struct("open_id", "open_n", "open_last"), "article_number").alias("s"))
    state = state.selectExpr("newsgroup", "s.open_id AS batch_id", "s.open_n AS n", "s.open_last AS last")
    got = {**collected(one), **collected(B.batch_feed(second, options, carried=state, block_size=16))}
    assert canonical(got) == canonical(loop(rows, 60, 300, 2))


@pytest.mark.parametrize("with_files", [False, True])
def test_gap_form_carries_what_the_rule_carries(spark, with_files):
    rows = feed(9)
    options = B.BatchOptions(gap=60, max_messages=2, start=str(START + timedelta(seconds=300)), stop=str(START + timedelta(seconds=5000)))
    has = F.col("has") if with_files else None
    parts = [spark.createDataFrame([r for r in rows if low < r[1] <= high], SCHEMA) for low, high in ((0, 50), (50, 90), (90, 200))]
    state = spark.createDataFrame([], "newsgroup string, batch_id bigint, n bigint, last bigint")
    for part in parts:
        quick = B.batch_feed(part, options, has, carried=state, block_size=16)
        slow = B.batch_feed(part, options, has, carried=state, block_size=16, exact_only=True)
        assert quick.columns == slow.columns
        assert sorted(map(tuple, quick.collect()), key=str) == sorted(map(tuple, slow.collect()), key=str)
        last = slow.groupBy("newsgroup").agg(F.max_by(F.struct("open_id", "open_n", "open_last"), "article_number").alias("s"))
        state = spark.createDataFrame(
            last.selectExpr("newsgroup", "s.open_id", "s.open_n", "s.open_last").collect(), state.schema
        )


def test_a_never_idle_feed_is_many_tasks(spark):
    """Half the messages have no files and none is a gap late: no Python task per feed in the plan."""
    rows = [("hot", n, START + timedelta(seconds=n), 1, n % 2 == 0) for n in range(1, 400)]
    df = spark.createDataFrame(rows, SCHEMA)
    batched = B.batch_feed(df, B.BatchOptions(gap=60, max_messages=5), F.col("has"), block_size=16)
    assert "MapInPandas" not in batched._jdf.queryExecution().toString()
    assert {b for a, b in collected(batched).values() if a == "saved"} == {2}


def test_merge_equals_greedy(spark):
    rng = random.Random(3)
    feeds = ["x", "y", "z"]
    rows = [(f, n, START + timedelta(seconds=rng.randint(0, 50))) for f in feeds for n in range(1, 40)]
    queues = {f: [r for r in rows if r[0] == f] for f in feeds}
    expected = []
    while any(queues.values()):
        best = min((f for f in feeds if queues[f]), key=lambda f: (queues[f][0][2], feeds.index(f)))
        expected.append(queues[best].pop(0)[:2])
    df = spark.createDataFrame(rows, "newsgroup string, article_number bigint, msg_time timestamp_ntz")
    assert [(r.newsgroup, r.article_number) for r in G.sync_merge(df, feeds, 8).collect()] == expected
