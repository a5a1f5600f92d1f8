"""Broken rounds of split files, damaged contents, urls."""

import hashlib
import random
from urllib.parse import urljoin

from pyspark.sql import functions as F

from tidewire.operators import payloads as P
from tidewire.sources.pages import resolve_url

PARTS = "newsgroup string, original string, article_number bigint, part_no int, n_parts int, checksum string, content binary"


def walk(rows):
    """Greedy reassembly in article order."""
    out, open_parts, count = [], {}, {}
    for group, name, article, part, total, checksum, content in sorted(rows, key=lambda r: r[2]):
        seen = open_parts.setdefault((group, name), {})
        number = count.setdefault((group, name), 1)
        seen[part] = content
        if len(seen) == total:
            whole = b"".join(seen[p] for p in sorted(seen))
            good = hashlib.md5(whole).hexdigest() == checksum
            out.append((group, name, number, "ok" if good else "mismatch", whole))
            open_parts[group, name] = {}
            count[group, name] += 1
    for (group, name), seen in open_parts.items():
        if seen:
            out.append((group, name, count[group, name], "incomplete", None))
    return sorted(out, key=str)


def test_join_parts_equals_walk(spark):
    rng = random.Random(1)
    rows, article = [], 0
    for name in ("whole", "lost", "twice", "late"):
        for post in range(6):
            contents = [bytes(f"{name}{post}.{p}", "ascii") for p in range(3)]
            checksum = hashlib.md5(b"".join(contents)).hexdigest()
            order = [0, 1, 2]
            if name == "lost" and post == 2:
                order = [0, 2]
            if name == "twice" and post in (1, 3):
                order = [0, 0, 1, 2]
            if name != "whole":
                rng.shuffle(order)
            for p in order:
                article += 1
                rows.append(("g", name, article, p, 3, checksum, contents[p]))
    df = spark.createDataFrame(rows[:-1], PARTS)
    got = P.join_parts(df, block_size=8).collect()
    found = sorted(((r.newsgroup, r.filename, r.assembly, r.status, bytes(r.content) if r.content else None) for r in got), key=str)
    assert found == walk(rows[:-1])


def test_missing_checksum_and_split_example(spark):
    files = spark.createDataFrame([("g", 1, "x.dat", b"0123456789")], "newsgroup string, article_number bigint, filename string, content binary")
    parts = P.split_files(files, 3)
    assert [(r.filename, r.part_no, r.n_parts, bytes(r.content)) for r in parts.orderBy("part_no").collect()] == [
        ("chunk.000", 0, 4, b"012"), ("chunk.001", 1, 4, b"345"), ("chunk.002", 2, 4, b"678"), ("chunk.003", 3, 4, b"9"),
    ]
    again = P.join_parts(parts.withColumn("article_number", F.col("part_no") + F.lit(1).cast("bigint")).withColumn("checksum", F.lit(None).cast("string")))
    row = again.first()
    assert (row.filename, row.status, bytes(row.content)) == ("x.dat", P.UNCHECKED, b"0123456789")


def test_damaged_content_keeps_its_error(spark):
    files = spark.createDataFrame([("a.gz", b"nonsense"), ("b.bz2", b"nonsense"), ("c.txt", b"fine")], "filename string, content binary")
    rows = {r.filename: r for r in P.uncompress(files).collect()}
    assert rows["a.gz"].error and rows["b.bz2"].error and rows["a.gz"].content is None
    assert rows["c.txt"].error is None and bytes(rows["c.txt"].content) == b"fine"


def test_empty_file_is_one_part(spark):
    files = spark.createDataFrame([("g", 1, "empty", b"")], "newsgroup string, article_number bigint, filename string, content binary")
    assert [(r.part_no, r.n_parts, bytes(r.content)) for r in P.split_files(files, 3).collect()] == [(0, 1, b"")]


def test_urls_resolve_as_in_a_browser(spark):
    bases = ["http://a.org/b/c/d.html?q=1", "https://a.org", "http://a.org/b/"]
    links = ["x.png", "/x/y", "../x", "../../x", "./x", "//c.org/z", "http://d.org/e", "?k=2", "#f", "", "x/../y", "/a/./b/../c", "mailto:x@y.z", "x?a=../b"]
    rows = [(b, link) for b in bases for link in links]
    df = spark.createDataFrame(rows, "base string, link string")
    for base, link, got in df.select("base", "link", resolve_url(F.col("base"), F.col("link"))).collect():
        assert got == urljoin(base, link), (base, link)


def test_files_are_changed_by_bytes_not_by_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE_BYTES", 50)
    rows = [(n, f"f{n}" + (".bz2" if n % 5 == 0 else ""), bytes([n]) * (n * 7 % 40)) for n in range(60)]
    files = spark.createDataFrame(rows, "n int, filename string, content binary").coalesce(1)
    packed = P.compress(files)
    assert "MapInArrow" in packed._jdf.queryExecution().executedPlan().toString()
    got = {r.n: r for r in P.uncompress(packed).collect()}
    assert len(got) == 60
    for n, name, content in rows:
        if n % 5:
            assert (got[n].filename, bytes(got[n].content), got[n].original_bytes, got[n].error) == (name, content, len(content), None)
        else:  # named as packed, but is not
            assert got[n].filename == (name if content else name[:-4]) and got[n].original_bytes == len(content)


def test_groups_take_the_columns_asked_for(spark):
    from tidewire.sources.files import file_groups

    files = spark.createDataFrame([("w", "/b", "b", b"2"), ("w", "/a", "a", b"1")], "watch string, path string, filename string, content binary")
    digests = file_groups(files.selectExpr("watch", "filename", "md5(content) AS digest"), True, ["filename", "digest"])
    assert [(f.filename, len(f.digest)) for f in digests.first().files] == [("a", 32), ("b", 32)]
    assert "content" not in digests.schema.simpleString()
    assert [f.path for f in file_groups(files, True).first().files] == ["/a", "/b"]
