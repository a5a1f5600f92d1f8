"""The spool source: every article once, over restarts, renumbering and expiry."""

import os
import random

import pytest

from tidewire.plans.storage import shared_path
from tidewire.sources import spool_stream
from tidewire.sources.spool import read_spool
from tidewire.sources.spool_stream import Spool, SpoolSource, stream_spool, unread_spool
from tidewire.streaming.epochs import EpochTable, run_batches

LAYOUT = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spool_stream.MESSAGES)

MULTIPART = """Subject: two
Content-Type: multipart/mixed; boundary=x

--x
Content-Type: text/plain; name=a.txt
Content-Disposition: attachment; filename=a.txt

one
--x
Content-Type: application/octet-stream
Content-Transfer-Encoding: base64

AAEC
--x--
"""


def put(root, feed, number, text=None):
    folder = os.path.join(root, *feed.split("."))
    os.makedirs(folder, exist_ok=True)
    with open(os.path.join(folder, str(number)), "w") as out:
        out.write(f"Subject: {feed} {number}\nX-A: 1\nX-A: 2\n\nbody {number}\n" if text is None else text)


def local(spark, name):
    path = shared_path(spark, name)
    path = path.removeprefix("file:")
    os.makedirs(path)
    return path


def rows(df):
    return sorted(map(repr, df.select("newsgroup", "article_number", "path", "headers", "is_multipart", "body", "parts", "n_bytes", "error").collect()))


def follow(spark, root, out, checkpoint, per_task=3):
    stream = stream_spool(spark, root, articles_per_task=per_task)
    run_batches(stream, lambda df, epoch: out.write(df, epoch) and None, checkpoint).awaitTermination()


def test_stream_equals_the_whole_spool(spark):
    root = local(spark, "spool")
    out = EpochTable(spark, f"{root}-out", LAYOUT)
    rng = random.Random(5)
    number = {"a": 0, "a.b": 0, "c": 10**12}
    for step in range(3):
        for feed in number:
            for _ in range(rng.choice([0, 1, 8]) if step else 5):
                number[feed] += rng.choice([1, 1, 7])
                put(root, feed, number[feed], rng.choice([None, None, MULTIPART, "\n", "Content-Type: text/plain; charset=none\n\nx"]))
        put(root, "a", "note.txt")
        put(root, "a", ".7.draft")
        put(root, "a._hidden", 1)
        follow(spark, root, out, f"{root}-checkpoint")
        assert rows(out.all()) == rows(read_spool(spark, root)), step
    assert rows(unread_spool(spark, root, {})) == rows(read_spool(spark, root))


def test_only_new_articles_are_opened(spark, monkeypatch):
    root = local(spark, "spool")
    for number in range(1, 41):
        put(root, "old", number)
        put(root, "far.behind", number)
    opened = []
    fetch = Spool.fetch
    monkeypatch.setattr(Spool, "fetch", lambda self, folder, name: opened.append((folder, int(name))) or fetch(self, folder, name))
    source = SpoolSource({"path": root, "articlesPerTask": "7"}).streamReader(spool_stream.MESSAGES)
    first = source.latestOffset()
    assert first == {"old": 40, "far/behind": 40} and source.partitions(first, first) == []
    put(root, "old", 41)
    put(root, "new", 5)
    parts = source.partitions(first, source.latestOffset())
    assert sum(batch.num_rows for part in parts for batch in source.read(part)) == 2
    assert sorted(opened) == [("new", 5), ("old", 41)]
    opened.clear()
    # one feed far behind, one up to date: marks are per feed
    reader = SpoolSource({"path": root, "marks": '{"old": 40, "far.behind": 3}', "articlesPerTask": "10"}).reader(spool_stream.MESSAGES)
    parts = reader.partitions()
    assert [len(p.names) for p in parts if p.folder == "far/behind"] == [10, 10, 10, 7]
    for part in parts:
        list(reader.read(part))
    assert sorted(opened) == [*(("far/behind", n) for n in range(4, 41)), ("new", 5), ("old", 41)]


def test_renumbered_feed_starts_over(spark):
    root = local(spark, "spool")
    out = EpochTable(spark, f"{root}-out", LAYOUT)
    for number in (8, 9, 10):
        put(root, "a", number)
        put(root, "b", number)
    follow(spark, root, out, f"{root}-checkpoint")
    for number in (8, 9, 10):
        os.remove(f"{root}/a/{number}")
    for number in (1, 2):
        put(root, "a", number)
    put(root, "b", 11)
    follow(spark, root, out, f"{root}-checkpoint")
    got = {(r.epoch, r.newsgroup, r.article_number) for r in out.all().collect()}
    assert got == {(0, f, n) for f in "ab" for n in (8, 9, 10)} | {(1, "a", 1), (1, "a", 2), (1, "b", 11)}


def test_expired_between_listing_and_reading(tmp_path):
    for number in (1, 2):
        put(str(tmp_path), "a", number)
    put(str(tmp_path), "a", 3, "")
    spool = Spool(str(tmp_path))
    parts = spool.ranges({}, spool.marks(), 10)
    os.remove(tmp_path / "a" / "2")
    assert [n for p in parts for b in spool.read(p) for n in b.column("article_number").to_pylist()] == [1, 3]
    with pytest.raises(FileNotFoundError):
        Spool(str(tmp_path / "nothing")).marks()


def test_a_spool_is_read_many_articles_to_a_task(spark):
    root = local(spark, "spool")
    for number in range(1, 200):
        put(root, "a.b", number)
    os.makedirs(f"{root}/c")
    open(f"{root}/c/7", "w").close()  # empty: passed over, as by Spark's readers
    read = read_spool(spark, root)
    assert "binaryFile" not in read._jdf.queryExecution().executedPlan().toString()
    assert read.count() == 199 and read.rdd.getNumPartitions() <= 2


def test_articles_share_a_boundary_that_no_part_can_hold():
    from tidewire.sinks.posts import _BOUNDARY, mime_bytes
    from tidewire.sources.spool import parse_article

    content = f"--{_BOUNDARY}\n--{_BOUNDARY}--\n".encode()
    raw = mime_bytes({"subject": "x"}, None, [{"content_type": "text/plain", "content": content, "filename": f"--{_BOUNDARY}"}] * 2)
    assert f"\n--{_BOUNDARY}\n".encode() in raw
    assert [p["content"] for p in parse_article(raw, 1)["parts"]] == [content] * 2
