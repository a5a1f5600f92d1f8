"""Changes from run to run: rows of the batch form for every split, checks seen before, contents left where they are."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidewire.operators.relay import content_changes, content_digests, header_changes, header_digest, tree_changes
from tidewire.plans.storage import shared_path
from tidewire.streaming.changes import StreamChanges

CONTENTS = "page string, check_no bigint, url_no int, content binary"
KEPT = ["page", "check_no"]


def checks(rng):
    """Pages whose contents stay the same for a while; some are not retrieved, some empty."""
    out = []
    for page in ["a", "b", None]:
        contents = {}
        for n in sorted(rng.sample(range(100), rng.choice([1, 12, 30]))):
            if rng.random() < 0.4:
                contents[rng.randint(0, 3)] = rng.choice([b"x", b"xy", b"", None])
            out.append((page, n, dict(contents) or {0: b"first"}))
    return out


def brute(checks):
    """Changed checks by comparing the contents themselves."""
    last, changed = {}, []
    for page, n, contents in checks:
        if page not in last or last[page] != contents:
            changed.append((page, n))
        last[page] = contents
    return changed


def frame(spark, checks):
    return spark.createDataFrame([(p, n, u, c) for p, n, contents in checks for u, c in contents.items()], CONTENTS)


def keys(df):
    return sorted(((r.page, r.check_no) for r in df.select(*KEPT).collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_over_new_checks_give_the_changes_of_the_whole(spark, seed):
    rng = random.Random(seed)
    every = checks(rng)
    expected = sorted(brute(every), key=str)
    assert keys(tree_changes(frame(spark, every), block_size=8)) == expected
    schema = "page string, check_no bigint, digest string, n_urls bigint"
    stream = StreamChanges(spark, shared_path(spark, "changes"), schema, content_digests, block_size=8, every=2)
    cuts = sorted(rng.sample(range(100), 3))
    for epoch in range(4):
        part = [c for c in every if sum(c[1] >= cut for cut in cuts) == epoch]
        again = [c for c in every if sum(c[1] >= cut for cut in cuts) == epoch - 1]  # seen before
        for _ in range(1 + epoch % 2):  # a micro-batch that runs again changes nothing
            stream.apply(frame(spark, part + again[-1:]), epoch)
    assert keys(stream.changes.all()) == expected
    newest = {r.page: r.last_no for r in stream.last.current(3).collect()}
    assert newest == {p: max(n for q, n, _ in every if q == p) for p in ["a", "b", None]}


def test_a_run_reads_new_checks_and_the_last_digests(spark):
    stream = StreamChanges(spark, shared_path(spark, "changes"), "page string, check_no bigint, digest string", lambda d: d, every=4)
    for epoch in range(10):
        stream.apply(spark.createDataFrame([("p", epoch, "d%d" % (epoch // 3))], "page string, check_no bigint, digest string"), epoch)
    assert keys(stream.changes.all()) == [("p", 0), ("p", 3), ("p", 6), ("p", 9)]
    opened = {f.split("/")[-3] + "/" + f.split("/")[-2] for f in stream.last.parts(9).inputFiles()}
    assert opened == {"folded/epoch=8", "touched/epoch=9"}


def test_no_content_is_shuffled(spark):
    path = shared_path(spark, "contents")
    frame(spark, [("a", 1, {0: b"x"})]).write.parquet(path)
    changed = tree_changes(spark.read.schema(CONTENTS).parquet(path))
    plan = changed._jdf.queryExecution().optimizedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate" in line]
    assert aggregates and not any("content#" in line for line in aggregates)
    assert all("content" not in column for column in content_digests(frame(spark, [])).columns)


def test_a_tree_of_several_nodes(spark):
    contents = {u: b"%d" % u for u in range(3000)}
    other = {**contents, 2999: b"new"}
    rows = [("a", 1, contents), ("a", 2, contents), ("a", 3, other), ("a", 4, {u: c for u, c in other.items() if u != 1500})]
    assert keys(tree_changes(frame(spark, rows))) == [("a", 1), ("a", 3), ("a", 4)]

    def md5(text):
        return hashlib.md5(text).hexdigest()

    nodes = [md5("\n".join(f"{u}:{md5(contents[u])}" for u in range(k, min(k + 1024, 3000))).encode()) for k in range(0, 3000, 1024)]
    got = content_digests(frame(spark, rows[:1])).first()
    assert (got.digest, got.n_urls) == (md5("\n".join(nodes).encode()), 3000)


def test_what_only_the_tree_tells_apart(spark):
    moved = [("a", 1, {0: b"ab", 1: b"c"}), ("a", 2, {0: b"a", 1: b"bc"}), ("a", 3, {0: b"a", 1: None, 2: b"bc"})]
    assert keys(content_changes(frame(spark, moved))) == [("a", 1)]
    assert keys(tree_changes(frame(spark, moved))) == [("a", 1), ("a", 2), ("a", 3)]


def test_headers_from_run_to_run(spark):
    schema = "page string, check_no bigint, headers array<struct<name:string,value:string>>"
    rows = [("p", n, [("Date", str(n)), ("Length", str(n // 4))]) for n in range(12)] + [("q", 5, None), ("q", 6, None), ("q", 7, [])]
    whole = spark.createDataFrame(rows, schema)
    expected = keys(header_changes(whole))
    # headers that are not known have no digest, as in the batch form: the first such check is no change there
    assert [k for k in expected if k[0] == "p"] == [("p", 0), ("p", 4), ("p", 8)]
    digests = lambda d: d.withColumn("digest", header_digest(F.col("headers")))
    stream = StreamChanges(spark, shared_path(spark, "changes"), "page string, check_no bigint, digest string", digests)
    for epoch, (low, high) in enumerate([(0, 3), (3, 6), (6, 99)]):
        stream.apply(whole.filter((F.col("check_no") >= low) & (F.col("check_no") < high)), epoch)
    got = keys(stream.changes.all())
    assert [k for k in got if k[0] == "p"] == [("p", 0), ("p", 4), ("p", 8)]
    assert [k for k in got if k[0] == "q"] == [("q", 5), ("q", 7)]


def test_nothing_came(spark):
    stream = StreamChanges(spark, shared_path(spark, "changes"), "page string, check_no bigint, digest string, n_urls bigint", content_digests)
    stream.apply(frame(spark, []), 0)
    stream.apply(frame(spark, [("a", 1, {0: b"x"})]), 1)
    assert keys(stream.changes.all()) == [("a", 1)]
