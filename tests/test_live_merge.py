"""Feeds merged as they arrive: ranks of the batch merge for every split; silent feeds; reruns."""

import random
from datetime import datetime, timedelta

import pytest

from tidewire.operators.merge import ranked, sync_merge
from tidewire.plans.storage import shared_path
from tidewire.streaming.merge import StreamMerge

SCHEMA = "newsgroup string, article_number bigint, msg_time timestamp_ntz, body string"
FEEDS = ["c", "a", "b"]
START = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else START + timedelta(seconds=seconds)


def feed(rng, name):
    """Times that go back and forth, with ties between feeds and, further on, none at all."""
    return [(name, n, at(None if rng.random() < 0.1 and n > 1 else n + rng.randint(-3, 3)), f"{name}{n}") for n in range(1, rng.choice([2, 20, 40]))]


def keys(df):
    return sorted((r["rank"], r.newsgroup, r.article_number, r.merge_time, r.feed_index, r.body) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_every_split_gives_the_ranks_of_the_batch_merge(spark, seed):
    rng = random.Random(seed)
    feeds = {name: feed(rng, name) for name in [*FEEDS, "other"]}
    whole = spark.createDataFrame([r for rows in feeds.values() for r in rows], SCHEMA)
    expected = keys(ranked(sync_merge(whole, FEEDS, 16)))
    merge = StreamMerge(spark, shared_path(spark, "merge"), SCHEMA, FEEDS, block_size=16)
    steps = 4
    cuts = {name: [0, *sorted(rng.randint(0, len(rows)) for _ in range(steps - 1)), len(rows)] for name, rows in feeds.items()}
    seen = 0
    for epoch in range(steps):
        part = [r for name, rows in feeds.items() for r in rows[cuts[name][epoch] : cuts[name][epoch + 1]]]
        rng.shuffle(part)
        for _ in range(1 + epoch % 2):  # a repeated micro-batch changes nothing
            merge.apply(spark.createDataFrame(part, SCHEMA), epoch)
        got = keys(merge.merged.all())
        assert got == expected[: len(got)] and len(got) >= seen
        seen = len(got)
    assert seen > 0
    assert sorted(keys(merge.merged.all()) + keys(merge.rest(steps - 1))) == expected


def names(df):
    return [r.body for r in sorted(df.collect(), key=lambda r: r["rank"])]


def test_a_silent_feed_is_not_waited_for(spark):
    clock = [0.0]
    merge = StreamMerge(spark, shared_path(spark, "merge"), SCHEMA, ["a", "b"], timeout=10, now=lambda: clock[0])

    def send(epoch, when, *rows):
        clock[0] = when
        merge.apply(spark.createDataFrame([(r[0], int(r[1:]), at(t), r) for r, t in rows], SCHEMA), epoch)
        return names(merge.merged.read(epoch))

    assert send(0, 0.0, ("a1", 100), ("a2", 200)) == []
    assert send(1, 9.0, ("a3", 300)) == []  # b may still begin
    assert send(2, 15.0, ("a4", 400)) == ["a1", "a2", "a3", "a4"]
    # b comes late: behind what went without it, whatever its times say, and holds a again
    assert send(3, 16.0, ("b1", 50), ("b2", 450), ("a5", 500)) == ["b1", "b2"]
    assert send(4, 17.0, ("a6", 600)) == []
    assert send(5, 30.0) == ["a5", "a6"]  # all are silent
    assert send(6, 31.0, ("a7", 10), ("a8", 700)) == ["a7", "a8"]
    rows = sorted(merge.merged.all().collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in rows] == list(range(1, 11))
    assert [r.merge_time for r in rows] == sorted(r.merge_time for r in rows)
