"""Steps of several widths from one pass: rows of resample and period_series for every split."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators.series import period_series, resample
from tidewire.plans.storage import shared_path
from tidewire.streaming.pyramid import SeriesPyramid

SCHEMA = "plotgroup string, variable string, seq bigint, ts timestamp_ntz, value double"
START = datetime(2024, 1, 1)
STEPS = ["10m", "30m", "2h"]


def samples(rng, out_of_order):
    """Series with gaps, unknown values and samples just on the bounds of steps."""
    rows = []
    for variable in ["u", "v", None]:
        minutes, seq = 0, 0
        for _ in range(rng.choice([1, 60, 120])):
            minutes += rng.choice([1, 3, 7, 10, 25, 30, 45, 90])
            seq += rng.randint(1, 3)
            back = rng.choice([0, 0, 0, 12, 200]) if out_of_order else 0
            second = rng.choice([0, 0, 17])
            ts = None if rng.random() < 0.03 else START + timedelta(minutes=minutes - back, seconds=second)
            rows.append(("g", variable, seq, ts, None if rng.random() < 0.1 else float(rng.randint(-50, 50))))
    return rows


def values(df):
    return sorted(
        ((*r[:3], None if r.value is None else round(r.value, 6), *r[4:]) for r in df.collect()), key=str
    )


def filled(spark, rows, cuts, **kwargs):
    pyramid = SeriesPyramid(spark, shared_path(spark, "pyramid"), STEPS, "40m", block_size=16, **kwargs)
    for epoch in range(len(cuts) + 1):
        part = [r for r in rows if sum(r[2] >= c for c in cuts) == epoch]
        for _ in range(1 + epoch % 2):  # a micro-batch that runs again changes nothing
            pyramid.apply(spark.createDataFrame(part, SCHEMA), epoch)
    return pyramid


@pytest.mark.parametrize("seed", [2])
def test_every_step_and_function(spark, seed):
    rng = random.Random(seed)
    rows = samples(rng, out_of_order=True)
    whole = spark.createDataFrame(rows, SCHEMA)
    pyramid = filled(spark, rows, sorted(rng.sample(range(1, 100), 2)), every=2)
    forms = [("10m", "AVERAGE"), ("10m", "LAST"), ("30m", "MAX"), ("2h", "AVERAGE"), ("2h", "MIN"), ("2h", "LAST")]
    for step, function in forms:
        assert values(pyramid.series(2, step, function)) == values(resample(whole, step, function, "40m", block_size=16))


@pytest.mark.parametrize("seed", [3])
def test_periods_that_begin_and_end_amid_the_samples(spark, seed):
    rng = random.Random(seed)
    rows = samples(rng, out_of_order=False)
    whole = spark.createDataFrame(rows, SCHEMA)
    pyramid = filled(spark, rows, [rng.randint(20, 90)])
    for hours in (10, 24):
        end = str(START + timedelta(hours=hours))
        periods = [("short", "2h", "10m"), ("middle", "4h", "30m"), ("long", "10h", "2h")]
        expected = period_series(whole, periods, end, "40m", 16)
        got = pyramid.periods(1, periods, end)
        assert values(got) == values(expected)


def test_new_samples_touch_their_own_steps(spark):
    rows = [("g", "u", n, START + timedelta(minutes=n), float(n)) for n in range(4320)]
    pyramid = filled(spark, rows, [1440, 2880])
    for level, per_day in zip(pyramid.levels, [144, 48, 12]):
        days = [{r.step_no for r in level.touched.read(e).collect()} for e in range(3)]
        assert [len(d) for d in days] == [per_day, per_day + 1, per_day + 1]  # and the one the day before ended in
        assert len(days[0] & days[1]) == 1 and not days[0] & days[2]


def test_retention(spark):
    rows = [("g", v, n, START + timedelta(minutes=n if v == "u" else n / 2), 1.0) for v in ("u", "w") for n in range(2880)]
    keep = ["2h", "6h", "30h"]
    pyramid = filled(spark, rows, [1000, 1900, 2400], retain=keep, every=2)
    free = filled(spark, rows, [1000, 1900, 2400])
    newest = {"u": START + timedelta(minutes=2879), "w": START + timedelta(minutes=2879 / 2)}
    for step, minutes, hours, level in zip(STEPS, [10, 30, 120], [2, 6, 30], pyramid.levels):
        ended = lambda r: r.ts + timedelta(minutes=minutes)
        whole = free.series(3, step).collect()
        expected = [r for r in whole if newest[r.variable] - ended(r) < timedelta(hours=hours)]
        assert sorted(pyramid.series(3, step).collect()) == sorted(expected) and {r.variable for r in expected} == {"u", "w"}
        if hours < 30:
            # what was folded holds no more than what is kept
            assert level.folded.read(2).count() < level.touched.some(range(3)).count()


def test_wrong_steps_and_bounds(spark):
    with pytest.raises(ValueError):
        SeriesPyramid(spark, "/nowhere", ["10m", "25m"], "1h")
    with pytest.raises(ValueError):
        SeriesPyramid(spark, "/nowhere", ["10m", "30m"], "1h", retain=["1h"])
    with pytest.raises(ValueError):
        filled(spark, [], []).series(0, "30m", start="2024-01-01 00:10:00")
