"""Logs by ranges of bytes: the records of the whole file at every cut; files that grow and rotate."""

import io
import os
import random

import pytest

from tidewire.plans.storage import shared_path
from tidewire.sources import log_ranges
from tidewire.sources.log_ranges import LogFolder, LogStreamReader, cut, follow_logs, pieces_of, read_log_ranges
from tidewire.sources.logs import parse_logs, read_logs
from tidewire.streaming.epochs import EpochTable, run_batches
from tidewire.streaming.flows import LOGS

FIELDS = ["asctime", "levelname", "name", "message", "exc_info", "threadName"]


def record(n, rng):
    more = rng.choice(["", "", "\n two\n\n three", "\nTraceback (most):\n  [x]\n{y}", "\n" * 3, "\r", "é" * 9, " "])
    return f"[2024-01-0{1 + n % 9} 00:00:00.{n:03d}   INFO] a/b: seen {n}{more}\n"


def json_line(n, rng):
    return rng.choice(["", " "]) + '{"asctime": "2024-01-01 00:00:00.%03d", "levelname": "INFO", "name": "j", "message": "m %d"}\n' % (n, n)


def odd(n, rng):
    return rng.choice(["\n", "junk\n", "[2024-01-01 broken] no\n", "[1, 2]\n", "{}\n", " [2024-01-01 00:00:00.1 INFO] x: indented\n", "[x\n", "[a 1.5 UP] b: headless\n"])


def content(rng):
    kinds = rng.choice([[record], [json_line], [record, odd], [json_line, odd], [record, json_line, odd], [odd]])
    text = "".join(rng.choice(kinds)(n, rng) for n in range(rng.choice([0, 1, 3, 12])))
    return text + "\n" * rng.choice([0, 0, 3]) if rng.random() < 0.7 else text.rstrip("\n")


def put(root, path, text, mode="w"):
    os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
    with open(f"{root}/{path}", mode, encoding="utf-8", newline="") as out:
        out.write(text)


def local(spark, name):
    path = shared_path(spark, name).removeprefix("file:")
    os.makedirs(path)
    return path


def in_order(df):
    rows = sorted(df.collect(), key=lambda r: (os.path.basename(r.path), r.record_no))
    return [(os.path.basename(r.path), *(r[c] for c in FIELDS)) for r in rows]


@pytest.mark.parametrize("length", [50, 1 << 20])
def test_ranges_give_the_records_of_whole_files(spark, length):
    rng = random.Random(11)
    root = local(spark, "logs")
    for n in range(40 if length > 50 else 12):
        put(root, f"d{n % 3}/{n:03d}.log", content(rng))
    got = in_order(read_log_ranges(spark, root, length))
    assert got == in_order(read_logs(spark, root)) and len(got) > 20


def test_every_cut_gives_the_same_pieces(monkeypatch):
    rng = random.Random(12)
    for block in (1, 16, 1 << 20):
        monkeypatch.setattr(log_ranges, "_BLOCK", block)
        for _ in range(60):
            data = content(rng).encode()
            whole = sorted(x for p in cut("", 0, len(data), len(data), max(1, len(data))) for x in pieces_of(io.BytesIO(data), p))
            for length in (1, 2, 3, 5, 11, 40):
                parts = cut("", 0, len(data), len(data), length)
                assert sorted(x for p in parts for x in pieces_of(io.BytesIO(data), p)) == whole, (data, length)


def polled(reader, start):
    """The new offset and the text pieces between."""
    end = reader.latestOffset()
    parts = reader.partitions(start, end)
    return end, [p.decode() for part in parts for batch in reader.read(part) for p in batch.column("piece").to_pylist()]


def line(n):
    return f"[2024-01-01 00:00:00.{n:03d}   INFO] a: {n}\n"


def bare(*numbers):
    return [line(n)[:-1] for n in numbers]


def test_growth_and_rotation(tmp_path):
    root = str(tmp_path)
    clock = [0.0]
    reader = LogStreamReader(LogFolder(root), 7, quiet=10.0, now=lambda: clock[0])
    put(root, "x.log", line(1) + line(2))
    end, got = polled(reader, {})
    assert got == bare(1)
    put(root, "x.log", "  more\n" + line(3), "a")
    end, got = polled(reader, end)
    assert got == [line(2) + "  more"]
    # moved with an unread end, and a new file of the same name
    put(root, "x.log", line(4), "a")
    os.rename(f"{root}/x.log", f"{root}/x.log.1")
    put(root, "x.log", line(50) + line(51))
    end, got = polled(LogStreamReader(LogFolder(root), 7, 10.0, lambda: clock[0]), end)
    assert sorted(got) == sorted(bare(3, 50))
    # moved on once more, copied and cut back
    os.rename(f"{root}/x.log.1", f"{root}/x.log.2")
    put(root, "x.log", line(52), "a")
    put(root, "x.log.1", open(f"{root}/x.log").read())
    put(root, "x.log", line(60))
    end, got = polled(reader, end)
    assert sorted(got) == sorted(bare(51))
    clock[0] = 10.0**12
    end, got = polled(reader, end)
    assert sorted(got) == sorted(bare(4, 52, 60))
    assert polled(reader, end)[1] == []
    os.remove(f"{root}/x.log.2")
    put(root, "x.log", line(61), "a")
    assert polled(reader, end)[1] == bare(61)


def test_a_record_that_goes_on_after_silence_is_given_again(tmp_path):
    clock = [10.0**12]
    reader = LogStreamReader(LogFolder(str(tmp_path)), 1000, quiet=10.0, now=lambda: clock[0])
    put(str(tmp_path), "x", line(1) + line(2))
    end, got = polled(reader, {})
    assert got == bare(1, 2)
    clock[0] = 0.0
    put(str(tmp_path), "x", " more\n", "a")
    end, got = polled(reader, end)
    assert got == []
    put(str(tmp_path), "x", line(3), "a")
    end, got = polled(reader, end)
    assert got == [line(2) + " more"]


def test_json_lines_wait_for_their_end(tmp_path):
    reader = LogStreamReader(LogFolder(str(tmp_path)), 5, quiet=1e15)
    put(str(tmp_path), "x", '{"a": 1}\n{"b"')
    end, got = polled(reader, {})
    assert got == ['{"a": 1}']
    put(str(tmp_path), "x", ": 2}\n", "a")
    assert polled(reader, end)[1] == ['{"b": 2}']


def test_stream_of_growing_files(spark):
    rng = random.Random(13)
    root = local(spark, "logs")
    out = EpochTable(spark, f"{root}-out", LOGS)
    for step in range(3):
        for n in range(6):
            put(root, f"{n}.log", "".join((record if n % 2 else json_line)(step * 10 + k, rng) for k in range(rng.choice([0, 1, 7]))), "a")
        stream = follow_logs(spark, root, 64, quiet=3600 if step < 2 else 0)
        run_batches(stream, lambda df, epoch: out.write(df, epoch) and None, f"{root}-checkpoint").awaitTermination()
    assert in_order(out.all()) == in_order(read_logs(spark, root))


def test_whole_files_are_held_by_ranges(spark, monkeypatch):
    """Every file gives what parse_logs makes of its whole text, though a task holds little of it."""
    rng = random.Random(14)
    root = local(spark, "logs")
    for n in range(40):
        put(root, f"d{n % 3}/{n:03d} %41.log", content(rng))
    texts = spark.read.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").load(root)
    expected = parse_logs(texts.selectExpr("_metadata.file_path AS path", "value AS content"))
    got = read_logs(spark, root)
    order = [*FIELDS, "path"]
    assert sorted(map(repr, got.select(order).collect())) == sorted(map(repr, expected.select(order).collect()))
    numbers = [r.record_no for r in got.orderBy("path", "record_no").collect()]
    assert numbers == [r.record_no for r in expected.orderBy("path", "record_no").collect()]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "wholetext" not in plan and "content" not in plan.split("Scan")[1]


def test_a_range_reads_little_beyond_its_end():
    class Counted(io.BytesIO):
        n = 0

        def read(self, size=-1):
            self.n += size
            return super().read(size)

    data = "".join(line(n % 1000) for n in range(20000)).encode()
    file = Counted(data)
    for part in cut("", 0, len(data), len(data), 1 << 14):
        list(pieces_of(file, part))
    assert file.n < 1.2 * len(data)


def test_many_short_ranges_are_few_tasks(monkeypatch, tmp_path):
    monkeypatch.setattr(log_ranges, "TASK_BYTES", 200)
    for n in range(30):
        put(str(tmp_path), f"{n}.log", line(n) * (1 if n else 50))
    tasks = log_ranges.LogReader(LogFolder(str(tmp_path)), 10).partitions()
    sizes = [sum(s.stop - s.start for s in t.stretches) for t in tasks]
    assert max(sizes) <= 200 and sum(sizes) == sum(os.path.getsize(tmp_path / f"{n}.log") for n in range(30))
    assert len(tasks) < 25
