"""The index of a message table: the rows of the plain operators from the files that have them."""

import random
from datetime import datetime, timedelta
from urllib.parse import unquote

from tidewire.operators import marks as M
from tidewire.operators import select as S
from tidewire.plans.storage import shared_path
from tidewire.sources.message_table import MessageTable

SCHEMA = "newsgroup string, article_number bigint, msg_time timestamp_ntz, body string"
FEEDS = ["a", "a b", "x%y+z", "7", "q:[1]", "007", "é=*"]


def rows_of(low, high, rng, feeds=FEEDS):
    start = datetime(2024, 1, 1)
    return [(f, n, None if rng.random() < 0.1 else start + timedelta(minutes=n + rng.randint(0, 9)), f"{f}{n}") for f in feeds for n in range(low, high)]


def table_of(spark, rng, batches=4):
    table = MessageTable(spark, shared_path(spark, "table"), SCHEMA, rows_per_file=10)
    rows = []
    for k in range(batches):
        part = rows_of(k * 50 + 1, k * 50 + 51, rng)
        rows += part
        rng.shuffle(part)
        for _ in range(1 + k % 2):  # a batch written again replaces itself
            table.append(spark.createDataFrame(part, SCHEMA), k)
    return table, spark.createDataFrame(rows, SCHEMA)


def collected(df):
    return sorted(map(tuple, df.select("newsgroup", "article_number", "msg_time", "body").collect()), key=repr)


def opened(df):
    return {unquote(f).rsplit("/", 1)[1] for f in df.inputFiles() if "/data/batch=" in unquote(f)}


def test_index_and_reads(spark):
    rng = random.Random(4)
    table, whole = table_of(spark, rng)
    assert collected(table.messages()) == collected(whole)
    assert sorted(map(tuple, table.feeds().select("newsgroup", "low", "high", "n_messages").collect())) == sorted((f, 1, 200, 200) for f in FEEDS)
    assert {r.n for r in table.index().collect()} <= set(range(1, 11))
    assert collected(table.recent("30m", "2024-01-01 03:20:00")) == collected(S.recent(whole, "30m", "2024-01-01 03:20:00"))
    assert collected(table.recent_to_newest("20m")) == collected(S.recent_to_newest(whole, "20m"))


def test_a_feed_far_behind_opens_no_files_of_others(spark):
    rng = random.Random(5)
    table, whole = table_of(spark, rng)
    # far behind, no mark, renumbered (both outside what there is), the others almost up to date
    marks = {"a": 3, "7": 999, "007": -5, "a b": 195, "q:[1]": 200, "é=*": 190}
    given = spark.createDataFrame(list(marks.items()), "newsgroup string, last_read bigint")
    new = table.unread(given)
    assert collected(new) == collected(M.unread(whole, given))
    start = {f: marks.get(f, 0) if 0 <= marks.get(f, 0) <= 200 else 0 for f in FEEDS}
    wanted = {r.file.rsplit("/", 1)[1] for r in table.index().collect() if r.high > start[r.newsgroup]}
    assert opened(new) == wanted
    assert len({r.file for r in table.index().collect() if r.newsgroup == "a b"} ) >= 20


def test_a_batch_without_its_index_is_not_there(spark):
    rng = random.Random(6)
    table, whole = table_of(spark, rng, 1)
    lost = spark.createDataFrame(rows_of(51, 60, rng), SCHEMA)
    lost.write.partitionBy("newsgroup").parquet(f"{table.root}/data/batch=1")
    assert collected(table.messages()) == collected(whole)
    table.append(lost, 1)
    assert collected(table.messages()) == collected(whole.unionByName(lost))


def test_empty(spark):
    table = MessageTable(spark, shared_path(spark, "table"), SCHEMA)
    marks = spark.createDataFrame([("a", 3)], "newsgroup string, last_read bigint")
    assert table.messages().count() == table.unread(marks).count() == table.recent("1h", "2024-01-01").count() == table.feeds().count() == 0
    table.append(spark.createDataFrame([], SCHEMA), 0)
    table.append(spark.createDataFrame([(None, 1, None, "x")], SCHEMA), 1)
    assert collected(table.messages()) == [(None, 1, None, "x")]
    assert table.unread(marks).count() == 0
