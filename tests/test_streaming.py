"""Streams give what the batch operators give, in whatever steps data arrives; timeouts; reruns."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import batches as B
from tidewire.plans.storage import shared_path
from tidewire.operators import payloads as P
from tidewire.sinks.raw import open_root
from tidewire.streaming.archive import StreamArchive, StreamJoin
from tidewire.streaming.commits import ArchiveLog
from tidewire.streaming.status import StreamLatest, StreamStatus

from test_batches import SCHEMA, canonical, collected, feed, loop


@pytest.mark.parametrize("cuts", [[40], [10, 11, 90]])
def test_archive_in_steps(spark, cuts):
    rows = feed(8)
    archive = StreamArchive(spark, shared_path(spark, "t"), B.BatchOptions(gap=60, span=300, max_messages=2), block_size=16)
    for epoch, (low, high) in enumerate(zip([0, *cuts], [*cuts, 10**6])):
        part = spark.createDataFrame([r for r in rows if low < r[1] <= high], SCHEMA)
        archive.apply(part, epoch)
        archive.apply(part, epoch)  # a repeated micro-batch changes nothing
    assert canonical(collected(archive.messages.all())) == canonical(loop(rows, 60, 300, 2))


def test_archive_timeout(spark):
    times = iter([0.0, 100.0, 100.0])
    archive = StreamArchive(spark, shared_path(spark, "t"), B.BatchOptions(gap="1 day"), timeout=50, now=lambda: next(times))
    start = datetime(2024, 1, 1)
    for epoch in range(2):
        rows = [("a", epoch * 2 + i, start + timedelta(seconds=epoch * 2 + i), 1, True) for i in (1, 2)]
        archive.apply(spark.createDataFrame(rows, SCHEMA), epoch)
    assert {r.batch_id for r in archive.batches().collect()} == {1, 3}
    assert [(r.batch_id, r.n_msgs) for r in archive.timed_out(1).collect()] == [(1, 2)]


def test_join_timeout_reports_incomplete(spark):
    clock = [0.0]
    join = StreamJoin(spark, shared_path(spark, "t"), timeout=10, now=lambda: clock[0], block_size=16)
    schema = "newsgroup string, original string, article_number bigint, part_no int, n_parts int, checksum string, content binary"
    join.apply(spark.createDataFrame([("g", "f", 1, 0, 2, None, b"a")], schema), 0)
    assert join.waiting.read(0).count() == 1
    clock[0] = 20.0
    join.apply(spark.createDataFrame([("g", "other", 2, 0, 2, None, b"x")], schema), 1)
    assert [(r.filename, r.status) for r in join.files.read(1).collect()] == [("f", "incomplete")]
    assert [r.original for r in join.waiting.read(1).collect()] == ["other"]


def test_latest_forgets_all_after_silence(spark):
    clock = [0.0]
    schema = "newsgroup string, article_number bigint, body string"
    latest = StreamLatest(spark, shared_path(spark, "t"), schema, timeout=10, now=lambda: clock[0])
    latest.apply(spark.createDataFrame([("a", 1, "x"), ("b", 1, "y"), ("a", 2, "z")], schema), 0)
    assert {(r.newsgroup, r.body) for r in latest.current(0).collect()} == {("a", "z"), ("b", "y")}
    clock[0] = 11.0
    assert latest.current(0).count() == 0
    latest.apply(spark.createDataFrame([("c", 1, "n")], schema), 1)
    assert {r.newsgroup for r in latest.current(1).collect()} == {"c"}


FILES = "newsgroup string, article_number bigint, msg_time timestamp_ntz, n_bytes bigint, part_no int, dest string, content binary"


def with_files(rows):
    """None, one or two files a message, in four destinations of a feed."""
    out = []
    for group, article, when, size, has in rows:
        n = 1 + article % 2 if has else 0
        out += [(group, article, when, size, k, f"d{(article + k) % 4}", f"{group}{article}.{k};".encode() * (1 + article % 3)) for k in range(n)]
        if not n:
            out.append((group, article, when, size, None, None, None))
    return out


def tree(root):
    fs, base = open_root(root)
    from pyarrow.fs import FileSelector, FileType

    found = fs.get_file_info(FileSelector(base, recursive=True))
    plain = [f for f in found if f.type == FileType.File and not f.base_name.startswith(".")]
    return {f.path[len(base) + 1 :]: fs.open_input_stream(f.path).read() for f in plain}


@pytest.mark.parametrize("options", [{"gap": 60}, {"max_messages": 7}])
def test_reports_and_files_of_a_stream_equal_those_of_the_batch_form(spark, options):
    rows = feed(11)
    options = B.BatchOptions(**options)
    whole = spark.createDataFrame(with_files(rows), FILES)
    messages = whole.groupBy("newsgroup", "article_number").agg(*(F.first(c).alias(c) for c in ("msg_time", "n_bytes")), F.bool_or(F.col("dest").isNotNull()).alias("has"))
    placed = B.batch_feed(messages, options, F.col("has"), block_size=16)
    wanted = B.feed_report(placed, options, block_size=16).filter("reason IS NOT NULL")
    files = whole.filter("dest IS NOT NULL").join(placed.filter("action = 'saved'").select("newsgroup", "article_number", "batch_id"), ["newsgroup", "article_number"])
    expected = shared_path(spark, "expected")
    P.write_archive(files.select("newsgroup", "article_number", "part_no", "batch_id", "dest", "content"), expected, max_messages=0, block_size=16).count()

    root = shared_path(spark, "t")
    log = ArchiveLog(spark, f"{root}/log", max_messages=0, chunk_bytes=20, block_size=16)
    archive = StreamArchive(spark, root, options, block_size=16, log=log)
    cuts = [0, 33, 90, 10**6]
    for epoch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        part = spark.createDataFrame([r for r in with_files(rows) if low < r[1] <= high], FILES)
        if epoch == 1:
            commit, log.commit = log.commit, lambda epoch: None
            archive.apply(part, epoch)  # killed between writing and the commit
            log.commit = commit
            assert log.last() == 0
        archive.apply(part, epoch)  # and run again
        assert log.last() == epoch
        if epoch != 1:
            log.publish(f"{root}/plain").count()
    columns = wanted.columns
    assert sorted(map(tuple, archive.reports.all().select(columns).collect())) == sorted(map(tuple, wanted.collect()))
    assert tree(f"{root}/plain") == tree(expected)
    listed = {f"{r.newsgroup}/{r.dest}": r.n_bytes for r in log.listing().collect()}
    assert listed == {k: len(v) for k, v in tree(expected).items()}


def test_uncommitted_bytes_are_not_published(spark):
    root = shared_path(spark, "t")
    log = ArchiveLog(spark, f"{root}/log", chunk_bytes=4)
    schema = "newsgroup string, dest string, article_number bigint, part_no int, batch_id bigint, content binary"

    def put(epoch, *rows, commit=True):
        log.write(spark.createDataFrame([("g", *r) for r in rows], schema), epoch)
        if commit:
            log.commit(epoch)
        return log.publish(f"{root}/plain").count()

    assert log.last() == -1 and log.chunks().count() == 0
    assert put(0, ("f", 1, 0, 1, b"one,"), ("f", 2, 0, 1, b"two,"), ("h", 2, 1, 1, b"h")) == 2
    assert put(1, ("f", 3, 0, 1, b"three,"), commit=False) == 0
    assert tree(f"{root}/plain") == {"g/f": b"one,two,", "g/h": b"h"}
    assert put(1, ("f", 3, 0, 1, b"three,")) == 1
    assert tree(f"{root}/plain")["g/f"] == b"one,two,three,"
    # a publication that was killed half way left a beginning of the file: only the rest is added
    fs, base = open_root(f"{root}/plain")
    with fs.open_output_stream(f"{base}/g/f") as out:
        out.write(b"one,t")
    assert put(2, ("h", 9, 0, 5, b"anew")) == 2
    assert tree(f"{root}/plain") == {"g/f": b"one,two,three,", "g/h": b"anew"}
    assert put(3, ("h", 10, 0, 1, b"an earlier batch does not come back")) == 0
    row = {r.dest: r for r in log.listing().collect()}
    assert (row["f"].n_files, row["f"].since, row["h"].n_files, row["h"].since) == (3, 0, 1, 2)


def test_one_file_a_message_and_files_that_stay(spark):
    schema = "newsgroup string, dest string, article_number bigint, part_no int, batch_id bigint, content binary"
    steps = [[("g", "f", 1, 0, 1, b"a"), ("g", "f", 2, 0, 1, b"b")], [("g", "f", 3, 0, 1, b"c"), ("g", "k", 3, 1, 1, b"k")]]
    for kind, expected in (({"max_messages": 1}, b"c"), ({"overwrite": False}, b"a")):
        root = shared_path(spark, "t")
        log = ArchiveLog(spark, f"{root}/log", **kind)
        for epoch, rows in enumerate(steps):
            log.append(spark.createDataFrame(rows, schema), epoch)
            log.publish(f"{root}/plain").count()
        assert tree(f"{root}/plain") == {"g/f": expected, "g/k": b"k"}


def test_status_turns_with_a_clock(spark):
    clock = [0.0]
    status = StreamStatus(spark, shared_path(spark, "t"), timeout=10, now=lambda: clock[0])
    at = lambda s: datetime(1970, 1, 1) + timedelta(seconds=s)
    # (clock, messages): what each micro-batch brings
    steps = [(5, [("a", 1), ("a", 4), ("b", 2)]), (9, [("b", 8)]), (16, [("b", 15)]), (30, []), (40, [("a", 33), ("a", 39)])]
    for epoch, (now, rows) in enumerate(steps):
        clock[0] = float(now)
        df = spark.createDataFrame([(g, at(s)) for g, s in rows], "newsgroup string, msg_time timestamp_ntz")
        status.apply(df, epoch)
    turns = [tuple(r)[:-1] + (r.epoch,) for r in status.turns.all().orderBy("epoch", "newsgroup").collect()]
    none = None
    assert turns == [
        ("a", "online", "unknown", False, at(1), at(1), at(4), none, none, 2, 0),
        ("b", "online", "unknown", False, at(2), at(2), at(2), none, none, 1, 0),
        ("a", "offline", "online", True, at(4), at(1), at(4), 3.0, none, 2, 2),
        ("b", "offline", "online", True, at(15), at(2), at(15), 13.0, none, 3, 3),
        ("a", "online", "offline", True, at(33), at(33), at(39), none, 29.0, 4, 4),
    ]
    feeds = {r.newsgroup: r for r in status.feeds.read(3).collect()}
    assert (feeds["a"].status, feeds["a"].off_time, feeds["b"].run_time) == ("offline", 26.0, 13.0)
