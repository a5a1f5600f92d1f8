"""Cases that the SQL of the registered queries does not have."""

import configparser
import html
import random
from datetime import datetime, timedelta
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from tidewire.functions.sizes import fixed
from tidewire.operators import batches as B
from tidewire.operators import machine
from tidewire.operators import marks as M
from tidewire.operators import payloads as P
from tidewire.operators import select as S
from tidewire.operators import series as I
from tidewire.operators.naming import parse_commands
from tidewire.plans import scan
from tidewire.plans.storage import shared_path
from tidewire.sources.logs import parse_logs
from tidewire.sources.pages import page_links
from tidewire.sources.snapshots import parse_snapshot
from tidewire.streaming.archive import StreamArchive
from test_batches import SCHEMA, START, feed


def test_joining_split_files_is_the_identity(spark):
    rng = random.Random(1)
    rows = [("g", k, f"f{k}", rng.randbytes(rng.choice([0, 1, 5, 6, 7, 40]))) for k in range(60)]
    files = spark.createDataFrame(rows, "newsgroup string, article_number bigint, filename string, content binary")
    parts = P.split_files(files, 6).withColumn("article_number", F.col("article_number") * 100 + F.col("part_no"))
    got = {r.filename: (bytes(r.content), r.status) for r in P.join_parts(parts).collect()}
    assert got == {name: (content, P.OK) for _, _, name, content in rows}


@pytest.mark.parametrize("chunk_bytes", [7, 1 << 20])
def test_archive_files_are_whole(spark, chunk_bytes):
    rng = random.Random(2)
    rows = [("g", k, 0, 0, f"d{k % 3}/x.dat", rng.randbytes(10)) for k in range(200)]
    files = spark.createDataFrame(rows, "newsgroup string, article_number bigint, part_no int, batch_id bigint, dest string, content binary")
    root = shared_path(spark, "archive")
    written = {r.dest: r.n_bytes for r in P.write_archive(files, root, max_messages=0, chunk_bytes=chunk_bytes, block_size=16).collect()}
    there = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).collect()
    got = {"/".join(r.path.split("/")[-3:]): bytes(r.content) for r in there}
    assert got == {f"g/d{d}/x.dat": b"".join(r[5] for r in rows if r[4] == f"d{d}/x.dat") for d in range(3)}
    assert written == {dest: len(content) for dest, content in got.items()}


def test_fixed_is_exact_at_every_size(spark):
    rng = random.Random(3)
    values = [10 ** rng.uniform(-3, 15) for _ in range(2000)] + [k + f for k in (0, 1, 2047, 2048, 4096, 10**9) for f in (0.0, 0.05, 0.25, 0.45, 0.5, 0.75, 0.95, 0.999)] + [2304.25, 1e18, 2.0**61]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in range(4):
        for v, text in df.select("v", fixed(F.col("v"), digits)).collect():
            assert text == f"{v:.{digits}f}", v


def test_all_batches_are_listed_without_a_limit(spark):
    rows = [("g", k, datetime(2024, 1, 1) + timedelta(seconds=k), 1, 1) for k in range(1500)]
    closed = spark.createDataFrame(rows, "newsgroup string, batch_id bigint, close_time timestamp_ntz, n_msgs bigint, n_bytes bigint")
    assert B.summary_files(closed, "1 day").count() == 1500
    assert B.summary_files(closed, "1 day", max_files=1200).count() == 1200


def test_timed_out_batches_are_kept(spark):
    times = iter([0.0, 100.0, 100.0, 100.0])
    archive = StreamArchive(spark, shared_path(spark, "t"), B.BatchOptions(gap="1 day"), timeout=50, now=lambda: next(times))
    for epoch, feed in enumerate("ab"):
        rows = [(feed, i, datetime(2024, 1, 1) + timedelta(seconds=i), 1, True) for i in (1, 2)]
        archive.apply(spark.createDataFrame(rows, SCHEMA), epoch)
    assert [tuple(r) for r in archive.timed_out(1).collect()] == [("a", 1, 2, "Time out reached")]


def test_no_time_counts_twice(spark):
    start = datetime(2024, 1, 1)
    minutes = [0, 40, 10, 50]
    rows = [("p", "v", k, start + timedelta(minutes=m), 1.0) for k, m in enumerate(minutes)]
    samples = spark.createDataFrame(rows, "plotgroup string, variable string, seq bigint, ts timestamp_ntz, value double")
    known = I.known_intervals(samples, "1h").selectExpr("sum(until - since)").first()[0]
    assert known == 50 * 60 * 10**6


def test_a_series_that_ended_is_unknown(spark):
    samples = spark.createDataFrame([("p", "v", 1, datetime(2024, 1, 1), 2.0)], "plotgroup string, variable string, seq bigint, ts timestamp_ntz, value double")
    rows = I.mark_gaps(samples, "1h", now="2024-01-01 05:00:00").orderBy("ts").collect()
    assert [(r.ts.hour, r.value) for r in rows] == [(0, 2.0), (1, None)]
    assert I.mark_gaps(samples, "1h", now="2024-01-01 00:30:00").count() == I.mark_gaps(samples, "1h").count() == 1


def test_null_keys_run_on(spark):
    df = spark.createDataFrame([(None, 1), (None, 20), ("a", 2), ("a", 30)], "k string, n bigint")
    rows = scan.running(df, ["k"], "n", {"count": scan.running_count()}, block_size=4).collect()
    assert sorted((str(r.k), r["count"]) for r in rows) == [("None", 1), ("None", 2), ("a", 1), ("a", 2)]


def test_entities_decode_once(spark):
    links = ["caf&eacute;.html", "b&#38;c.html", "q&#x2F;r.png", "a&amp;lt;b", "&nosuch;x", "&#0;", "&#128512;&lt;", "plain", "a&b;c"]
    pages = spark.createDataFrame([(k, "http://a.org/", f'<a href="{v}">t</a>') for k, v in enumerate(links)], "page_id bigint, url string, html string")
    got = {r.page_id: r.link for r in page_links(pages, ["*"], []).collect() if r.kind == "link"}
    for k, v in enumerate(links):
        expected = v if v in ("&nosuch;x", "&#0;", "a&b;c") else html.unescape(v)
        assert got[k].endswith(expected.split("#")[0]) if "#" not in expected else got[k], (v, got[k])


def test_log_records_by_position(spark):
    text = "[2024-01-01 00:00:00.123   INFO] a/b: seen: x\n[2024-01-01 00:00:01,5 ERROR] c: one\n two\n[2024-01-02 broken] no\n"
    rows = parse_logs(spark.createDataFrame([("p", text)], "path string, content string")).orderBy("record_no").collect()
    assert [(r.levelname, r["name"], r.message) for r in rows][0] == ("INFO", "a/b", " seen: x")


def test_log_patterns():
    assert S.expand_log_patterns(["a/b/c"]) == ["a/b/c", "a/b/c/*"]
    assert S.expand_log_patterns(["a/b/c", "d"], recursive=True, parents=True) == ["a/b/c", "d", "a/b", "a", "a/b/c/**", "d/**", "a/b/**", "a/**"]


def pushed(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_incremental_reads_reach_the_scan(spark):
    start = datetime(2024, 1, 1)
    rows = [("g" if k % 2 else "h", k, start + timedelta(hours=k)) for k in range(1, 100)]
    path = shared_path(spark, "messages")
    spark.createDataFrame(rows, "newsgroup string, article_number bigint, msg_time timestamp_ntz").write.parquet(path)
    messages = spark.read.parquet(path)
    marks = spark.createDataFrame([("g", 91), ("h", 80)], "newsgroup string, last_read bigint")
    new = M.unread(messages, marks)
    assert "GreaterThan(article_number,80)" in pushed(new)
    assert {r.article_number for r in new.collect()} == {*range(93, 100, 2), *range(82, 100, 2)}
    assert "GreaterThan(article_number,80)" in pushed(M.unread(messages, marks, S.feed_marks(messages)))
    late = S.recent_to_newest(messages, "5h")
    assert "GreaterThanOrEqual(msg_time,2024-01-04T21:00)" in pushed(late)
    assert {r.article_number for r in late.collect()} == {94, 96, 98, 95, 97, 99} | {93 + 1}
    samples = messages.selectExpr("'p' AS plotgroup", "newsgroup AS variable", "article_number AS seq", "msg_time AS ts")
    assert I.retain(samples, "5h").count() == 6


def test_snapshots_equal_the_configuration_parser():
    rng = random.Random(4)
    for _ in range(300):
        lines = ["[s]"]
        for _ in range(rng.randint(0, 12)):
            key, value = rng.choice("aBcd"), rng.choice(["1", "x y", "p=q", "", "u:v"])
            lines.append(rng.choice([f"[{rng.choice(['s', 't', 'DEFAULT'])}]", f"{key} = {value}", f"{key}: {value}  ", "# note", "; note", ""]))
        text = "\n".join(lines) + "\n"
        known = configparser.ConfigParser(strict=False, interpolation=None)
        known.read_string(text)
        expected = {n: dict(known[n]) for n in known.sections()}
        got = parse_snapshot(text)
        assert {n: v for n, v in got.items() if n != "DEFAULT"} == expected, text


def test_continued_values_equal_the_configuration_parser():
    rng = random.Random(6)
    for _ in range(4000):
        lines = ["[s]"]
        for _ in range(rng.randint(0, 14)):
            option = f"{rng.choice('aBcd')} {rng.choice('=:')} {rng.choice(['1', 'x  y', 'p=q', '', 'u:v', '[z]'])}"
            deep = rng.choice(["  ", "\t", "    "])
            lines.append(rng.choice([f"[{rng.choice(['s', 't u', 'DEFAULT'])}]", option, option, "# note", "; note", "", "   ", f"{deep}# note", f"{deep}more", f"{deep}k = 1", f"{deep}[t]"]))
        text = "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
        known = configparser.ConfigParser(strict=False, interpolation=None)
        try:
            known.read_string(text)
        except configparser.ParsingError:
            continue
        expected = {n: dict(known[n]) for n in known.sections()}
        assert {n: v for n, v in parse_snapshot(text).items() if n != "DEFAULT"} == expected, text


def test_command_paths_and_parts(spark):
    names = ["a", "a/b", "/abs/x", "a//b", "./a", "a/.", "", "//two", "///three", "..", "/", "."]
    parts = "newsgroup string, article_number bigint, body string, parts array<struct<part_no:int,filename:string,content_type:string,content:binary>>"
    rows = [("g", i, f"start={n}", None) for i, n in enumerate(names)]
    rows += [("g", 90, "stop=body", [(0, "x", "t", b"Start = one\nno\nstop=two=three"), (1, "y", "t", b"reload=four")]), ("g", 91, None, []), ("g", 92, None, None)]
    df = spark.createDataFrame(rows, parts)
    for prefix, postfix in (("Groups", "main"), ("", ""), ("/p/", "q/"), ("", "/post")):
        got = {r.article_number: r.target for r in parse_commands(df, prefix, postfix).filter("article_number < 90").collect()}
        assert got == {i: str(PurePosixPath(prefix, n, postfix)) for i, n in enumerate(names)}
    found = parse_commands(df, "Groups").filter("article_number >= 90").collect()
    assert sorted((r.part_no, r.line_no, r.command, r.target, r.kind) for r in found) == [(0, 0, "start", "Groups/one", "start"), (1, 0, "reload", "Groups/four", "unknown")]


@pytest.mark.parametrize("gap,span,limit", [(60, 0, 0), (0, 300, 0), (60, 300, 2), (0, 0, 3), (0, 300, 2)])
def test_reasons_equal_the_machine(spark, gap, span, limit):
    rows = feed(5)
    low, high = START + timedelta(seconds=200), START + timedelta(seconds=4000)
    options = B.BatchOptions(gap=gap or None, span=span or None, max_messages=limit, start=str(low), stop=str(high))
    placed = B.batch_feed(spark.createDataFrame(rows, SCHEMA), options, block_size=16)
    got = {(r.newsgroup, r.batch_id): r.reason for r in B.feed_report(placed, options, 16).collect()}
    states, expected = {}, {}
    for group, article, when, _, _ in rows:
        state = states.setdefault(group, machine.OpenBatch())
        t, was = int((when - datetime(1970, 1, 1)).total_seconds()) * 10**6, state.batch_id
        action, reason = machine.step(state, article, t, low <= when <= high, True, gap * 10**6, span * 10**6, limit)
        if reason:
            expected[group, was] = reason
        if action == machine.SAVED:
            expected.setdefault((group, state.batch_id), None)
            now = state.batch_id
            if machine.after(state, span, gap, limit):
                expected[group, now] = machine.COUNT
    assert got == expected


def test_inputs_are_scanned_once_or_twice(spark, tmp_path, monkeypatch):
    """However many blocked scans follow each other, what is below them is not doubled by each."""
    table = str(tmp_path / "feed")
    spark.createDataFrame(feed(3), SCHEMA).write.parquet(table)
    read = lambda: spark.read.schema(SCHEMA).parquet(table)

    def scans(df):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        return plan.count("Relation [")

    options = B.BatchOptions(gap=60)
    assert scans(B.batch_feed(read(), options, F.col("has"), block_size=16)) <= 2
    mixed = B.BatchOptions(gap=60, span=300, max_messages=2)
    assert scans(B.feed_report(B.batch_feed(read(), mixed, block_size=16), mixed, 16)) <= 3
    parts = read().selectExpr("newsgroup", "'f' AS original", "article_number", "0 AS part_no", "1 AS n_parts")
    assert scans(P.assemblies(parts, 16)) <= 4


def test_images_and_links_are_chosen_apart(spark):
    html = '<a href="l.html">x</a><img src="i.png"><a href="m.html">y</a>'
    pages = spark.createDataFrame([(1, "http://h.example/d/", html)], "page_id bigint, url string, html string")

    def got(**switches):
        rows = page_links(pages, **switches).orderBy("link_no").collect()
        return [(r.link_no, r.kind, r.link.rsplit("/", 1)[1]) for r in rows]

    page, first, image, second = (0, "page", ""), (1, "link", "l.html"), (2, "image", "i.png"), (3, "link", "m.html")
    assert got() == [page, first, image, second]
    assert got(images=False) == [page, first, second]
    assert got(links=False, body=False) == [image]
    assert got(links=False, images=False) == [page]
