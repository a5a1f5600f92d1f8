"""Snapshots and time series."""

from pyspark.sql import functions as F

from tidewire.catalog import query
from tidewire.operators import series as I
from tidewire.sources import snapshots as A

BLOCK = 1 << 14


def snapshots(t):
    """Each event as a status snapshot: INI body, site header."""
    body = F.expr(
        r"concat('[DEFAULT]\nsite = ', site, '\nunit: C\n\n[Reading]\n# taken by hand\nValue = ', CAST(value AS STRING), "
        r"' degC\nkind=', split_part(newsgroup, '.', 3), '\n\n[Extra]\nk = 1\nk = ', CAST(n_bytes AS STRING), "
        r"'\nunit = K\nnote = two\n  lines\n', CASE WHEN event_id % 3 = 0 THEN concat('[Rare]\nid = ', CAST(event_id AS STRING), '\n') ELSE '' END)"
    )
    headers = F.create_map(F.lit("x-site"), F.col("site"))
    return t.feed.select("newsgroup", "article_number", "msg_time", headers.alias("headers"), body.alias("body"))


_BASE = "SELECT newsgroup, article_number, msg_time, {section} AS section, {key} AS key, {value} AS value FROM feed"
_VALUE_TEXT = "CAST(value AS VARCHAR)"


def _entry(section, key, value, where=""):
    return _BASE.format(section=f"'{section}'", key=f"'{key}'", value=value) + where


_SNAPSHOT_SQL = " UNION ALL ".join(
    [
        _entry("DEFAULT", "site", "site"), _entry("DEFAULT", "unit", "'C'"),
        _entry("Reading", "site", "site"), _entry("Reading", "unit", "'C'"),
        _entry("Reading", "value", f"concat({_VALUE_TEXT}, ' degC')"),
        _entry("Reading", "kind", "split_part(newsgroup, '.', 3)"),
        _entry("Extra", "site", "site"), _entry("Extra", "unit", "'K'"),
        _entry("Extra", "k", "CAST(n_bytes AS VARCHAR)"), _entry("Extra", "note", "E'two\\nlines'"),
        _entry("Rare", "site", "site", " WHERE event_id % 3 = 0"), _entry("Rare", "unit", "'C'", " WHERE event_id % 3 = 0"),
        _entry("Rare", "id", "CAST(event_id AS VARCHAR)", " WHERE event_id % 3 = 0"),
    ]
)


@query("a4_read_snapshots", _SNAPSHOT_SQL)
def _(t):
    return A.read_snapshots(snapshots(t))


VARIABLES = [
    I.Variable("north", "value", "Reading", headers={"X-Site": "site[01]"}, filter=True, minimum=1.0, maximum=90.0),
    I.Variable("south", "value", "Reading", headers={"X-Site": "site[23]"}, filter=True),
    I.Variable("south", "id", "Rare"),
]


@query(
    "i1_extract_variables",
    """SELECT 'north' AS plotgroup, 'value' AS variable, newsgroup, article_number AS seq, msg_time AS ts, true AS found,
              CASE WHEN value BETWEEN 1 AND 90 THEN value END AS value FROM feed WHERE site IN ('site0', 'site1')
       UNION ALL SELECT 'south', 'value', newsgroup, article_number, msg_time, true, value FROM feed WHERE site IN ('site2', 'site3')
       UNION ALL SELECT 'south', 'id', newsgroup, article_number, msg_time, event_id % 3 = 0, CASE WHEN event_id % 3 = 0 THEN CAST(event_id AS DOUBLE) END
       FROM feed WHERE site IN ('site1', 'site2', 'site3')""",
)
def _(t):
    groups = {"south": {"X-Site": "site[123]"}}
    return I.extract_variables(snapshots(t), VARIABLES, groups, missing="report")


@query(
    "i2_numeric_filter",
    """SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL ELSE CASE WHEN event_id % 4 = 2 THEN -value ELSE value END END AS number FROM events""",
)
def _(t):
    text = F.expr(
        "CASE event_id % 4 WHEN 0 THEN concat('T=', value, ' degC') WHEN 1 THEN concat('+', value, '%') "
        "WHEN 2 THEN concat('(-', value, ')') ELSE 'none' END"
    )
    return t.events.select("event_id", I.numeric_filter(text).alias("number"))


@query("i3_valid_range", "SELECT event_id, CASE WHEN value >= 10 AND value <= 60 THEN value END AS value FROM events")
def _(t):
    return t.events.select("event_id", I.valid_range(F.col("value"), 10.0, 60.0).alias("value"))


_KNOWN = """
linked AS (SELECT *, epoch_us(ts) AS until, max(epoch_us(ts)) OVER (PARTITION BY plotgroup, variable ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS since FROM {source}),
known AS (SELECT * FROM linked WHERE until > since AND until - since <= {timeout}),
pieces AS (SELECT *, unnest(generate_series(CAST(floor(since / {step}) AS BIGINT), CAST(floor((until - 1) / {step}) AS BIGINT))) AS step_no FROM known),
cut AS (SELECT *, least(until, (step_no + 1) * {step}) - greatest(since, step_no * {step}) AS covered FROM pieces)"""


def _resample_sql(source, step, timeout, value="sum(value * covered) / sum(covered)"):
    ctes = _KNOWN.format(source=source, step=step, timeout=timeout)
    out = f"""SELECT plotgroup, variable, make_timestamp(CAST(step_no * {step} AS BIGINT)) AS ts,
              CASE WHEN sum(covered) >= 0.5 * {step} THEN round({value}, 6) END AS value FROM cut GROUP BY plotgroup, variable, step_no"""
    return ctes, out


HOUR = 3600000000
_R_CTES, _R_OUT = _resample_sql("samples", HOUR, 6 * HOUR)


def rounded(df):
    return df.withColumn("value", F.round("value", 6))


@query("i4_resample", f"WITH {_R_CTES} {_R_OUT}")
def _(t):
    return rounded(I.resample(t.samples, "1h", "AVERAGE", "6h", block_size=BLOCK))


_SHUFFLED = "(SELECT plotgroup, variable, seq, CASE WHEN seq % 5 = 0 THEN ts - INTERVAL 3 HOUR ELSE ts END AS ts, value FROM samples)"
_R_BACK, _R_BACK_OUT = _resample_sql(_SHUFFLED, HOUR, 6 * HOUR)


@query("i4_resample_out_of_order", f"WITH {_R_BACK} {_R_BACK_OUT}")
def _(t):
    moved = t.samples.withColumn("ts", F.expr("CASE WHEN seq % 5 = 0 THEN ts - INTERVAL 3 HOURS ELSE ts END"))
    return rounded(I.resample(moved, "1h", "AVERAGE", "6h", block_size=BLOCK))


_R_MAX, _R_MAX_OUT = _resample_sql("samples", 4 * HOUR, 6 * HOUR, "max(value)")


I4_MAX_SQL = f"WITH {_R_MAX} {_R_MAX_OUT}"


@query("i4_resample_max", I4_MAX_SQL)
def _(t):
    return rounded(I.resample(t.samples, "4h", "MAX", "6h", block_size=BLOCK))


_R_LAST, _R_LAST_OUT = _resample_sql("samples", 4 * HOUR, 6 * HOUR, "arg_max(value, seq)")


I4_LAST_SQL = f"WITH {_R_LAST} {_R_LAST_OUT}"


@query("i4_resample_last", I4_LAST_SQL)
def _(t):
    return rounded(I.resample(t.samples, "4h", "LAST", "6h", block_size=BLOCK))


@query(
    "i5_mark_gaps",
    """WITH linked AS (SELECT *, lag(ts) OVER (PARTITION BY plotgroup, variable ORDER BY seq) AS before FROM samples)
       SELECT plotgroup, variable, seq, ts, value FROM linked
       UNION ALL SELECT plotgroup, variable, seq, before + INTERVAL 2 HOUR, NULL FROM linked WHERE ts - before > INTERVAL 2 HOUR
       UNION ALL SELECT plotgroup, variable, max(seq), arg_max(ts, seq) + INTERVAL 2 HOUR, NULL FROM samples GROUP BY 1, 2 HAVING arg_max(ts, seq) < TIMESTAMP '2024-02-10' - INTERVAL 2 HOUR""",
)
def _(t):
    return I.mark_gaps(t.samples, "2h", block_size=BLOCK, now="2024-02-10 00:00:00")


@query(
    "i6_retain",
    """SELECT plotgroup, variable, seq, ts, value FROM samples
       QUALIFY max(ts) OVER (PARTITION BY plotgroup, variable) - ts < INTERVAL 2 DAY""",
)
def _(t):
    return I.retain(t.samples, "2 days")


_PERIODS = [("hours", "12h", "1h", 12 * HOUR, HOUR), ("day", "1 day", "2h", 24 * HOUR, 2 * HOUR), ("week", "1 week", "12h", 168 * HOUR, 12 * HOUR)]
END = "2024-01-29 00:00:00"


def _period_sql(name, span, step):
    source = f"(SELECT * FROM samples WHERE ts > TIMESTAMP '{END}' - to_microseconds({span}) AND ts <= TIMESTAMP '{END}')"
    ctes, out = _resample_sql(source, step, 6 * HOUR)
    return f"SELECT *, '{name}' AS period FROM (WITH {ctes} {out})"


I7_SQL = " UNION ALL ".join(_period_sql(n, span, step) for n, _, _, span, step in _PERIODS)
PERIODS = [(n, span, step) for n, span, step, _, _ in _PERIODS]


@query("i7_period_series", I7_SQL)
def _(t):
    return rounded(I.period_series(t.samples, PERIODS, END, "6h", BLOCK))


@query(
    "i8_bounded_series",
    "SELECT * FROM samples WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts <= TIMESTAMP '2024-01-06 12:00:00'",
)
def _(t):
    return I.bounded_series(t.samples, "2024-01-05 00:00:00", "2024-01-06 12:00:00")


@query(
    "i9_derived_series",
    f"""WITH {_R_CTES}, series AS ({_R_OUT}),
        wide AS (SELECT plotgroup, ts, max(value) FILTER (variable = 'view') AS v, max(value) FILTER (variable = 'click') AS c,
                        max(value) FILTER (variable = 'error') AS e FROM series GROUP BY 1, 2)
        SELECT plotgroup, ts, round(v - c, 6) AS lead, round(v + c + coalesce(e, 0), 6) AS total FROM wide""",
)
def _(t):
    series = rounded(I.resample(t.samples, "1h", "AVERAGE", "6h", block_size=BLOCK))
    expressions = {"lead": "round(view - click, 6)", "total": "round(view + click + coalesce(error, 0), 6)"}
    return I.derived_series(series, ["view", "click", "error"], expressions)


@query(
    "i10_stacked_series",
    f"""WITH {_R_CTES}, series AS ({_R_OUT}),
        placed AS (SELECT *, CASE variable WHEN 'purchase' THEN 0 WHEN 'view' THEN 1 ELSE 2 END AS i FROM series
                   WHERE variable IN ('purchase', 'view', 'signup'))
        SELECT plotgroup, variable, ts, value,
               round(sum(coalesce(value, 0)) OVER (PARTITION BY plotgroup, ts ORDER BY i ROWS UNBOUNDED PRECEDING) + i * 2.5, 6) AS stacked
        FROM placed""",
)
def _(t):
    series = rounded(I.resample(t.samples, "1h", "AVERAGE", "6h", block_size=BLOCK))
    stacked = I.stacked_series(series, ["purchase", "view", "signup"], 2.5)
    return stacked.withColumn("stacked", F.round("stacked", 6))
