import fnmatch
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewire.functions import content, globs, sizes, template, times


def one(spark, *columns):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()


def column(spark, values, make, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(make(F.col("v"))).collect()]


@pytest.mark.parametrize(
    "value, metric, precision, expected",
    [
        (200, True, 1, "200.0 B"),
        (2000, True, 1, "2.0 kB"),
        (2000000, True, 1, "2.0 MB"),
        (2000000000, True, 1, "2.0 GB"),
        (2000000000000, True, 1, "2.0 TB"),
        (2000, False, 1, "2.0 KiB"),
        (2000000, False, 1, "1.9 MiB"),
        (2000000000, False, 1, "1.9 GiB"),
        (2000000000000, False, 1, "1.8 TiB"),
        (1234, True, 2, "1.23 kB"),
        (1234, True, 3, "1.234 kB"),
        (1023.95, True, 0, "1 kB"),
        (-600, True, 0, "-600 B"),
        (2304, False, 1, "2.2 KiB"),
        (0, False, 1, "0.0 B"),
    ],
)
def test_size_desc(spark, value, metric, precision, expected):
    assert one(spark, sizes.size_desc(F.lit(value), metric, precision))[0] == expected


@pytest.mark.parametrize("digits", [0, 1, 2, 3])
def test_fixed_equals_printf(spark, digits):
    rng = random.Random(digits)
    values = [0.0, 0.25, 0.5, 1.5, 2.5, 2.25, 2.35, 2.45, 0.05, 0.125, 1023.95, 999.9995, 0.0005]
    values += [rng.random() * 10 ** rng.randint(-2, 3) for _ in range(300)]
    values += [round(rng.random() * 1000, digits + 1) for _ in range(300)]
    got = column(spark, values, lambda c: sizes.fixed(c, digits), "double")
    assert got == [f"{v:.{digits}f}" for v in values]


def test_parse_bytes(spark):
    good = {
        "10": 10, "1 b": 1, "1 Kb": 1024, "1 Mb": 1024**2, "1 Gb": 1024**3, "1b": 1, "1Kb": 1024,
        "1Mb": 1024**2, "1Gb": 1024**3, "12mB": 12 * 1024**2, "12MB": 12 * 1024**2, "12Mb": 12 * 1024**2,
        "20Mb": 20 * 1024**2,
    }
    assert column(spark, list(good), sizes.parse_bytes) == list(good.values())
    assert [sizes.bytes_value(t) for t in good] == list(good.values())
    bad = ["sdf", "213kjh", "ds 23kB"]
    assert column(spark, bad, sizes.parse_bytes) == [None] * 3
    for text in bad:
        with pytest.raises(ValueError):
            sizes.bytes_value(text)


def test_parse_timedelta(spark):
    good = {
        "0": 0, "9": 9, "5s": 5, "2:23": 143, "43:23": 2603, "23:32:43": 84763, "1 day": 86400,
        "2 days": 172800, "2.5 days": 216000, "1 days 12:34:45": 131685, "10m": 600, "1h 30m": 5400,
        "2 hours 3 min": 7380, "1 week": 604800, "1:00:00": 3600, "-5s": -5,
    }
    assert column(spark, list(good), times.parse_timedelta) == [float(v) for v in good.values()]
    assert [times.duration(t) for t in good] == [float(v) for v in good.values()]
    bad = ["32:2", "1 days 2", "1 days 23:23", "", "abc"]
    assert column(spark, bad, times.parse_timedelta) == [None] * 5
    for text in bad:
        with pytest.raises(ValueError):
            times.duration(text)


def test_time_conversions(spark):
    interval = F.expr("INTERVAL '1 02:03:04.000005' DAY TO SECOND")
    assert one(spark, times.seconds(interval))[0] == pytest.approx(93784.000005, abs=1e-9)
    stamp = F.lit("2004-12-25 12:34:56")
    parsed = times.strptime(stamp, "%Y-%m-%d %H:%M:%S")
    row = one(spark, times.strftime(parsed, "%Y-%m-%d %H:%M:%S"), times.epoch(parsed))
    assert row == ("2004-12-25 12:34:56", 1103978096.0)
    assert one(spark, times.strptime(F.lit("2004 360 01:02:03"), "%Y %j %H:%M:%S"))[0] == datetime(2004, 12, 25, 1, 2, 3)
    assert one(spark, times.strptime(F.lit("nonsense"), "%Y-%m-%d"))[0] is None


def test_strftime_matches_python(spark):
    moments = [datetime(2024, 1, 2, 3, 4, 5, 678), datetime(2023, 12, 31, 23, 59, 59), datetime(2024, 2, 29, 12)]
    for fmt in ["%Y%m%d-%H%M%S.txt", "%j/%y %a %A %b %B %I%p", "%c", "100%% of %Y's", "T%H:%M", "plain"]:
        got = column(spark, moments, lambda c: times.strftime(c, fmt), "timestamp_ntz")
        assert got == [m.strftime(fmt) for m in moments], fmt


def test_template(spark):
    rule = {"rule": F.lit("hello world"), "name": F.lit("b")}
    group = {"group": (F.lit("comp.lang.python"), ".")}
    header = {"header": F.create_map(F.lit("x-transport-date"), F.lit("2005-06-15"))}
    cases = [
        ("<rule>", rule, "hello world"),
        ("<otherrule>", rule, "<otherrule>"),
        ("<rule>-<name>", {"rule": F.lit("a"), "name": F.lit("b")}, "a-b"),
        ("<rule>", {"rule": F.lit(0)}, "0"),
        ("Before <rule> after", rule, "Before hello world after"),
        ("More: <group[0:2]> <group[-1]>", group, "More: comp.lang python"),
        ("<group>", group, "comp.lang.python"),
        ('D: <header["x-transport-date"]>', header, "D: 2005-06-15"),
        ("<header>", header, None),
    ]
    for text, values, expected in cases[:-1]:
        assert one(spark, template.render(text, values))[0] == expected


def test_slices_match_python(spark):
    items = list("abcde")
    bounds = [None, -7, -3, -1, 0, 2, 5, 9]
    cases = [(a, b, c) for a in bounds for b in bounds for c in (None, 1, 2, -1, -2)]
    for at in range(0, len(cases), 80):
        chunk = cases[at : at + 80]
        array = F.array(*[F.lit(i) for i in items])
        row = one(spark, *[template.slice_array(array, *c) for c in chunk])
        assert [list(v) for v in row] == [items[slice(*c)] for c in chunk]


def test_globs_match_fnmatch(spark):
    names = ["transport.demo.a", "transport.demo", "a/b.txt", "x[1]", "doc-1.en.txt", "b^c", "", "A", "]", "a\nb", "!x", "a.b"]
    patterns = ["*", "transport.*", "*.txt", "?", "x[[]1]", "doc-[0-9].*", "[!a]*", "*[.]*", "b^c", "[]]", "[!]]*", "a?b", "[", "a.b", "[!!]x"]
    for pattern in patterns:
        got = column(spark, names, lambda c: globs.glob(c, pattern))
        assert got == [fnmatch.fnmatchcase(n, pattern) for n in names], pattern
    simple = ["*", "transport.*", "*.txt", "?", "doc-[0-9].*", "[!a]*", "a.b", "b^c"]
    df = spark.createDataFrame([(n, p) for n in names for p in simple], "n string, p string")
    for n, p, hit in df.select("n", "p", globs.glob_column(F.col("n"), F.col("p"))).collect():
        assert hit == fnmatch.fnmatchcase(n, p), (n, p)


def test_content(spark):
    names = ["a.txt", "b.html", "c.gz", "d.unknownext", "noext", "e.PNG", "x/y.jpg", "f.tar.bz2"]
    assert column(spark, names, content.content_type) == [
        "text/plain", "text/html", content.DEFAULT_TYPE, content.DEFAULT_TYPE, content.DEFAULT_TYPE,
        "image/png", "image/jpeg", content.DEFAULT_TYPE,
    ]
    assert column(spark, ["text/plain", "image/png", "x/nothing"], content.extension_of) == [".txt", ".png", ".bin"]
    message, trace = content.split_traceback(F.lit("it failed  \nTraceback (most recent call last):\n x"))
    assert one(spark, message, trace) == ("it failed", "Traceback (most recent call last):\n x")
    message, trace = content.split_traceback(F.lit("fine"))
    assert one(spark, message, trace) == ("fine", None)


def test_next_tick(spark):
    at = F.lit("2024-01-01 00:07:00").cast("timestamp_ntz")
    row = one(
        spark,
        times.next_tick(at, "5m"),
        times.next_tick(at, "5m", offset=60),
        times.next_tick(at, "5m", sync=False),
        times.next_tick(F.lit("2024-01-01 00:05:00").cast("timestamp_ntz"), "5m"),
    )
    assert list(row) == [
        datetime(2024, 1, 1, 0, 10), datetime(2024, 1, 1, 0, 11),
        datetime(2024, 1, 1, 0, 12), datetime(2024, 1, 1, 0, 10),
    ]


def test_log_name_patterns(spark):
    from tidewire.operators.select import log_name_matches

    names = ["a", "a/b", "a/b/c", "a.b", "ab", "a/", "a(b)/c"]
    df = spark.createDataFrame([(n,) for n in names], "name string")

    def kept(*patterns):
        return [r["name"] for r in df.where(log_name_matches(F.col("name"), patterns)).collect()]

    assert kept("a/*") == ["a/b"]
    assert kept("a/**") == ["a/b", "a/b/c", "a/"]
    assert kept("a.b") == ["a.b"] and kept("a(b)/*") == ["a(b)/c"]
    assert kept("!a/b", "a/**") == ["a/b/c", "a/"]
    assert kept("**/c", "*") == ["a", "a/b/c", "a.b", "ab", "a(b)/c"]
