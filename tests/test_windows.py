"""Windows by event time on streams: rows in time counted as in the batch form, late ones kept, state bounded."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.functions.times import from_micros
from tidewire.plans.storage import shared_path
from tidewire.streaming.epochs import run_batches
from tidewire.streaming.windows import OnTime, append_final, period_counts, sessions

SCHEMA = "newsgroup string, article_number bigint, msg_time timestamp_ntz, n_bytes bigint"
START = datetime(2024, 1, 1)


def arrivals(rng, n=200):
    """Micro-batches in which times go forward, some rows far behind, some without a time."""
    rows, seconds = [], 0
    for i in range(n):
        seconds += rng.choice([0, 1, 5, 10, 10, 30])
        back = rng.choice([0, 0, 0, 0, 5, 20, 200])
        ts = None if rng.random() < 0.02 else START + timedelta(seconds=seconds - back, microseconds=rng.choice([0, 0, 1, 999999]))
        rows.append((rng.choice("ab"), i, ts, rng.randint(0, 9)))
    cuts = [0, *sorted(rng.sample(range(1, n), 3)), n]
    return [rows[a:b] for a, b in zip(cuts, cuts[1:])]


def split(batches, delay):
    """What is in time and what is late, by the rule itself."""
    newest, timely, late = None, [], []
    for rows in batches:
        here = [r for r in rows if r[2] is not None and (newest is None or r[2] >= newest - delay)]
        timely += here
        late += [r for r in rows if r not in here]
        newest = max([r[2] for r in here] + ([newest] if newest else []), default=None)
    return timely, late


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_windows_of_the_stream_are_those_of_the_rows_in_time(spark, seed):
    batches = arrivals(random.Random(seed))
    root = shared_path(spark, "windows")
    came = OnTime(spark, f"{root}/times", SCHEMA, "15s")
    forms = {
        "counts": lambda rows: period_counts(rows, "20s", "5s", "15s"),
        "sessions": lambda rows: sessions(rows, "10s", "15s"),
    }
    for epoch, rows in enumerate(batches):
        for _ in range(1 + epoch % 2):  # a micro-batch that runs again changes nothing
            came.apply(spark.createDataFrame(rows, SCHEMA), epoch)
        for name, form in forms.items():
            if epoch % 2:  # a query may fall behind and catch up
                append_final(came.stream(), form, f"{root}/{name}", f"{root}/{name}-checkpoint").awaitTermination()
    timely, late = split(batches, timedelta(seconds=15))
    stored = [came.on_time.all().drop("epoch"), came.late.all().drop("epoch")]
    assert sorted(map(str, rows_of_any(stored[0]))) == sorted(map(str, timely))
    assert sorted(map(str, rows_of_any(stored[1]))) == sorted(map(str, late)) and late
    mark = F.lit(came.watermark(len(batches) - 1))
    whole = spark.createDataFrame(timely, SCHEMA)
    counts = forms["counts"](whole).filter(F.col("end_time") <= from_micros(mark))
    assert rows_of(spark.read.parquet(f"{root}/counts")) == rows_of(counts) and counts.count() > 3
    done = forms["sessions"](whole).filter(F.col("last_time") + F.expr("INTERVAL 9999999 MICROSECONDS") <= from_micros(mark))
    assert rows_of(spark.read.parquet(f"{root}/sessions")) == rows_of(done) and done.count() > 3


def rows_of_any(df):
    return [tuple(r) for r in df.collect()]


def brute_sessions(rows, gap):
    out = []
    for feed in sorted({r[0] for r in rows}):
        run = []
        for r in sorted((r for r in rows if r[0] == feed and r[2]), key=lambda r: r[2]):
            if run and r[2] - run[-1][2] >= gap:
                out.append(run)
                run = []
            run.append(r)
        out.append(run)
    return sorted((run[0][0], run[0][2], run[-1][2], len(run), sum(r[3] for r in run)) for run in out if run)


@pytest.mark.parametrize("seed", [4, 5])
def test_sessions_by_their_rule(spark, seed):
    rows = [r for batch in arrivals(random.Random(seed)) for r in batch]
    assert rows_of(sessions(spark.createDataFrame(rows, SCHEMA), "10s")) == brute_sessions(rows, timedelta(seconds=10))


def test_state_is_what_is_still_open(spark):
    root = shared_path(spark, "windows")
    came = OnTime(spark, f"{root}/times", SCHEMA, "1m")
    kept = []
    for epoch in range(4):
        rows = [("a", epoch * 500 + i, START + timedelta(seconds=epoch * 5000 + 10 * i), 1) for i in range(500)]
        came.apply(spark.createDataFrame(rows, SCHEMA), epoch)
        query = append_final(came.stream(), lambda r: period_counts(r, "1m", 0, "1m"), f"{root}/out", f"{root}/checkpoint")
        query.awaitTermination()
        kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(kept) <= 3  # of 83 windows a micro-batch
    assert spark.read.parquet(f"{root}/out").agg(F.sum("n_msgs")).first()[0] > 1900


def test_a_stream_without_rows_in_time(spark):
    root = shared_path(spark, "windows")
    came = OnTime(spark, root, SCHEMA, 0)
    came.apply(spark.createDataFrame([("a", 1, None, 1)], SCHEMA), 0)
    assert came.watermark(0) is None and came.late.all().count() == 1
    came.apply(spark.createDataFrame([], SCHEMA), 1)
    came.apply(spark.createDataFrame([("a", 2, START, 1)], SCHEMA), 2)
    assert came.on_time.all().count() == 1 and came.watermark(2) is not None


def test_what_a_stream_has_read_is_never_written_again(spark):
    root = shared_path(spark, "windows")
    came = OnTime(spark, f"{root}/times", SCHEMA, 0)
    rows = spark.createDataFrame([("a", 1, START, 1)], SCHEMA)
    seen = []
    for _ in range(2):
        came.apply(rows, 0)
        run_batches(came.stream(), lambda df, e: seen.append(df.count()), f"{root}/checkpoint").awaitTermination()
    assert sum(seen) == 1
