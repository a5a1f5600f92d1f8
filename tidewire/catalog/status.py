"""Status, alarms and state history."""

from pyspark.sql import functions as F

from tidewire.catalog import query
from tidewire.operators import monitor as N
from tidewire.operators import status as H

BLOCK = 1 << 14
START, STOP = "2024-01-01 00:00:00", "2024-01-31 00:00:00"


def activity(t, period="1h", timeout="30m"):
    feed = t.feed.select("newsgroup", "msg_time")
    return H.poll_activity(feed, feed.select("newsgroup").distinct(), START, STOP, period, timeout)


_ACTIVITY = """
ticks AS (SELECT newsgroup, unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-31', INTERVAL 1 HOUR)) AS tick
          FROM (SELECT DISTINCT newsgroup FROM feed)),
hits AS (SELECT newsgroup, msg_time, CASE WHEN msg_time = date_trunc('hour', msg_time) THEN msg_time
                ELSE date_trunc('hour', msg_time) + INTERVAL 1 HOUR END AS tick FROM feed),
activity AS (
  SELECT newsgroup, tick, count(msg_time) AS n_msgs, min(msg_time) AS first_message, max(msg_time) AS last_message
  FROM ticks LEFT JOIN (SELECT * FROM hits WHERE tick - msg_time <= INTERVAL 30 MINUTE) USING (newsgroup, tick)
  GROUP BY 1, 2)"""


@query("e4_poll_activity", f"WITH {_ACTIVITY} SELECT * FROM activity")
def _(t):
    return activity(t)


@query(
    "e4_poll_activity_sliding",
    """WITH ticks AS (SELECT newsgroup, unnest(generate_series(TIMESTAMP '2024-01-01 00:05:00', TIMESTAMP '2024-01-31', INTERVAL 20 MINUTE)) AS tick
                      FROM (SELECT DISTINCT newsgroup FROM feed))
       SELECT t.newsgroup, t.tick, count(msg_time) AS n_msgs, min(msg_time) AS first_message, max(msg_time) AS last_message
       FROM ticks t LEFT JOIN feed f ON f.newsgroup = t.newsgroup AND msg_time BETWEEN t.tick - INTERVAL 50 MINUTE AND t.tick
       GROUP BY 1, 2""",
)
def _(t):
    feed = t.feed.select("newsgroup", "msg_time")
    feeds = feed.select("newsgroup").distinct()
    return H.poll_activity(feed, feeds, START, STOP, "20m", "50m", offset="5m")


@query("h1_instrument_status", f"WITH {_ACTIVITY} SELECT *, CASE WHEN n_msgs > 0 THEN 'online' ELSE 'offline' END AS status FROM activity")
def _(t):
    return H.instrument_status(activity(t))


_TRANSITIONS = f"""{_ACTIVITY},
status AS (SELECT *, CASE WHEN n_msgs > 0 THEN 'online' ELSE 'offline' END AS status FROM activity),
marked AS (
  SELECT *, coalesce(lag(status) OVER w, 'unknown') AS was, lag(last_message) OVER w AS seen
  FROM status WINDOW w AS (PARTITION BY newsgroup ORDER BY tick)),
set_times AS (
  SELECT *, CASE WHEN status = 'online' AND was <> 'online' THEN first_message
                 WHEN status = 'offline' AND was = 'unknown' THEN tick END AS set_start,
            CASE WHEN status = 'online' AND was = 'online' THEN last_message
                 WHEN status = 'offline' AND was = 'online' THEN seen
                 WHEN status = 'offline' AND was = 'unknown' THEN tick END AS set_stop
  FROM marked),
timed AS (
  SELECT *, last_value(set_start IGNORE NULLS) OVER w AS start_time, last_value(set_stop IGNORE NULLS) OVER w AS stop_time,
         last_value(set_stop IGNORE NULLS) OVER (PARTITION BY newsgroup ORDER BY tick
                                                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stop_before
  FROM set_times WINDOW w AS (PARTITION BY newsgroup ORDER BY tick ROWS UNBOUNDED PRECEDING)),
spent AS (
  SELECT *, CASE WHEN was = 'online' THEN (epoch_us(stop_time) - epoch_us(start_time)) / 1e6 END AS ran,
         CASE WHEN status = 'online' AND was = 'offline' THEN (epoch_us(start_time) - epoch_us(stop_before)) / 1e6
              WHEN status = 'offline' AND was = 'offline' THEN (epoch_us(tick) - epoch_us(stop_time)) / 1e6 END AS off
  FROM timed),
transitions AS (
  SELECT newsgroup, tick, status, was AS previous_status, was <> 'unknown' AND was <> status AS changed, start_time, stop_time,
         CASE WHEN was <> 'unknown' AND was <> status THEN CASE status WHEN 'online' THEN start_time ELSE stop_time END END AS change_time,
         coalesce(last_value(ran IGNORE NULLS) OVER w, 0.0) AS run_time, coalesce(last_value(off IGNORE NULLS) OVER w, 0.0) AS off_time
  FROM spent WINDOW w AS (PARTITION BY newsgroup ORDER BY tick ROWS UNBOUNDED PRECEDING))"""


def transitions(t):
    return H.status_transitions(H.instrument_status(activity(t)))


@query("h2_status_transitions", f"WITH {_TRANSITIONS} SELECT * FROM transitions")
def _(t):
    return transitions(t)


@query(
    "h3_feed_health",
    f"""WITH {_ACTIVITY}, members AS (
          SELECT DISTINCT newsgroup, CASE WHEN newsgroup LIKE '%s%e%' THEN 'first' ELSE 'second' END AS feed,
                 newsgroup LIKE '%s%e%' AS always_on FROM feed)
        SELECT feed, tick, count(*) AS n_groups, count(*) FILTER (n_msgs > 0) AS n_active, CAST(sum(n_msgs) AS BIGINT) AS n_msgs,
               CASE WHEN count(*) FILTER (n_msgs > 0) = count(*) THEN 'online' WHEN count(*) FILTER (n_msgs > 0) > 0 THEN 'warning'
                    WHEN bool_or(always_on) THEN 'error' ELSE 'offline' END AS state
        FROM activity JOIN members USING (newsgroup) GROUP BY 1, 2""",
)
def _(t):
    members = t.feed.select("newsgroup").distinct().selectExpr(
        "newsgroup", "CASE WHEN newsgroup LIKE '%s%e%' THEN 'first' ELSE 'second' END AS feed",
        "newsgroup LIKE '%s%e%' AS always_on",
    )
    return H.feed_health(activity(t), members)


_INTERVALS = """
flagged AS (SELECT *, lag(state) OVER w AS prev FROM observations WINDOW w AS (PARTITION BY member ORDER BY seq)),
runs AS (SELECT *, max(CASE WHEN prev IS NULL OR prev <> state THEN seq END)
                   OVER (PARTITION BY member ORDER BY seq ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
grouped AS (SELECT member, run, arg_min(state, seq) AS state, arg_min(ts, seq) AS start_time, arg_max(ts, seq) AS end_ts,
                   coalesce(arg_min(prev, seq), 'unknown') AS previous_state
            FROM runs GROUP BY 1, 2),
linked AS (SELECT *, lead(start_time) OVER w AS next_start, row_number() OVER w AS n FROM grouped
           WINDOW w AS (PARTITION BY member ORDER BY run)),
intervals AS (
  SELECT member, run, state, start_time, coalesce(next_start, end_ts) AS last_time, next_start IS NULL AS is_open,
         CASE WHEN n = 1 THEN 'unknown' ELSE previous_state END AS previous_state FROM linked
  UNION ALL SELECT member, run - 1, 'unknown', start_time, start_time, false, NULL FROM linked WHERE n = 1),
timed AS (SELECT *, (epoch_us(last_time) - epoch_us(start_time)) / 1e6 AS elapsed FROM intervals)"""


@query("h4_state_intervals", f"WITH {_INTERVALS} SELECT * FROM timed")
def _(t):
    return H.state_intervals(t.observations, BLOCK)


@query(
    "h5_state_history",
    f"""WITH {_INTERVALS}, ranked AS (
          SELECT member, row_number() OVER (PARTITION BY member ORDER BY run DESC) AS recency, state AS name, start_time, last_time
          FROM intervals WHERE NOT is_open)
        SELECT * FROM ranked WHERE recency <= 10""",
)
def _(t):
    return H.state_history(H.state_intervals(t.observations, BLOCK), 10)


_CHANGED = """
ranked AS (SELECT *, lag(state) OVER w AS prev, row_number() OVER (PARTITION BY member ORDER BY seq DESC) AS r
           FROM observations WINDOW w AS (PARTITION BY member ORDER BY seq)),
changed AS (SELECT member, state, ts, coalesce(prev, 'unknown') AS previous_state, state <> coalesce(prev, 'unknown') AS changed
            FROM ranked WHERE r = 1)"""


@query("h6_changed_members", f"WITH {_CHANGED} SELECT * FROM changed")
def _(t):
    return H.changed_members(t.observations)


@query(
    "h7_state_board",
    f"""WITH {_CHANGED}, board AS (SELECT concat('server', member) AS label, state, changed, ts FROM changed),
        facts AS (SELECT max(length(label)) AS width, count(*) FILTER (changed) AS n,
                         max(CASE WHEN changed THEN concat(label, ' ', upper(state[1]), state[2:]) END) AS one FROM board)
        SELECT label, state, changed,
               concat('  ', lpad(label, CAST(width AS INT), ' '), ': ', rpad(concat(upper(state[1]), state[2:]), 10, ' '), ' ',
                      CASE WHEN changed THEN concat('<-- ', rtrim(rtrim(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')) ELSE '' END) AS line,
               CASE WHEN n > 1 THEN 'Multiple instruments have changed status' WHEN n = 1 THEN one END AS subject
        FROM board CROSS JOIN facts""",
)
def _(t):
    states = H.changed_members(t.observations).selectExpr(
        "concat('server', member) AS label", "state", "changed", "ts AS change_time"
    )
    return H.state_board(states)


_TEXT = "rtrim(rtrim(strftime({0}, '%Y-%m-%d %H:%M:%S.%f'), '0'), '.')"


@query(
    "h8_instrument_notices",
    f"""WITH {_TRANSITIONS}, facts AS (
          SELECT *, CASE status WHEN 'online' THEN 'started' ELSE 'stopped' END AS action FROM transitions WHERE changed)
        SELECT newsgroup, tick, concat(newsgroup, ' has ', action) AS subject,
               concat(E'\\n  The following instrument has ', action, E' sending data:\\n\\n    Instrument: ', newsgroup,
                      E'\\n    Date/Time : ', {_TEXT.format('change_time')},
                      CASE status WHEN 'online' THEN E'\\n    Offline   : ' ELSE E'\\n    Online    : ' END,
                      CAST(CASE status WHEN 'online' THEN off_time ELSE run_time END AS VARCHAR), E'\\n') AS body
        FROM facts""",
)
def _(t):
    return H.instrument_notices(transitions(t))


@query(
    "h8_state_notices",
    f"""WITH {_INTERVALS}, linked2 AS (
          SELECT *, lag(state) OVER w AS l_state, lag(start_time) OVER w AS l_start, lag(last_time) OVER w AS l_last, lag(elapsed) OVER w AS l_elapsed
          FROM timed WINDOW w AS (PARTITION BY member ORDER BY run)),
        facts AS (SELECT *, CASE state WHEN 'online' THEN 'started' ELSE 'stopped' END AS action FROM linked2 WHERE l_state IS NOT NULL)
        SELECT member, run, concat(member, ' has ', action) AS subject,
               concat(E'\\n  The following instrument has ', action, E' sending data:\\n\\n    Instrument: ', member,
                      E'\\n    Date/Time : ', strftime(start_time, '%a, %d %b %Y %H:%M:%S UTC'),
                      E'\\n    Currently : ', upper(state[1]), state[2:],
                      E'\\n\\n  Previous state: ', upper(l_state[1]), l_state[2:],
                      E'\\n    Start time: ', strftime(l_start, '%a, %d %b %Y %H:%M:%S UTC'),
                      E'\\n    Stop time : ', strftime(l_last, '%a, %d %b %Y %H:%M:%S UTC'),
                      E'\\n    Elapsed   : ', CAST(l_elapsed AS VARCHAR), E'\\n') AS body
        FROM facts""",
)
def _(t):
    return H.state_notices(H.state_intervals(t.observations, BLOCK), BLOCK)


# ----------------------------------------------------------- disks, rates

_ALARMS = """
flagged AS (SELECT *, usedpct >= 80 AS alarm, lag(usedpct >= 80) OVER (PARTITION BY mount ORDER BY seq) AS last_alarm FROM usage),
noted AS (
  SELECT *, alarm <> coalesce(last_alarm, false) AS changed,
         CASE WHEN alarm AND NOT coalesce(last_alarm, false) THEN 'Alarm set' WHEN last_alarm AND NOT alarm THEN 'Cleared alarm'
              WHEN alarm THEN 'Low space alarm' ELSE '' END AS notes FROM flagged)"""


@query("h9_disk_alarms", f"WITH {_ALARMS} SELECT mount, seq, snapshot, ts, usedpct, totalbytes, alarm, changed, notes FROM noted")
def _(t):
    return N.disk_alarms(t.usage, 80.0, block_size=BLOCK)


_SIZES = """CASE WHEN {n} < 1023.95 THEN format('{{:.1f}} B', {n} * 1.0)
     WHEN {n} / 1024.0 < 1023.95 THEN format('{{:.1f}} KiB', {n} / 1024.0)
     WHEN {n} / 1048576.0 < 1023.95 THEN format('{{:.1f}} MiB', {n} / 1048576.0)
     WHEN {n} / 1073741824.0 < 1023.95 THEN format('{{:.1f}} GiB', {n} / 1073741824.0)
     ELSE format('{{:.1f}} TiB', {n} / 1099511627776.0) END"""


@query(
    "h10_disk_report",
    f"""WITH {_ALARMS}, hot AS (SELECT DISTINCT snapshot FROM noted WHERE changed),
        amounts AS (SELECT *, CAST(floor(totalbytes * usedpct / 100) AS BIGINT) AS used FROM noted)
        SELECT snapshot, mount, {_SIZES.format(n='totalbytes')} AS total, {_SIZES.format(n='used')} AS used_desc,
               {_SIZES.format(n='(totalbytes - used)')} AS avail, format('{{:.1f}}%', usedpct) AS pct_full, notes
        FROM amounts JOIN hot USING (snapshot)""",
)
def _(t):
    usage = t.usage.withColumn("usedbytes", F.floor(F.col("totalbytes") * F.col("usedpct") / 100))
    usage = usage.withColumn("freebytes", F.col("totalbytes") - F.col("usedbytes"))
    return N.disk_report(N.disk_alarms(usage, 80.0, block_size=BLOCK))


@query(
    "h11_disk_usage",
    """WITH blocks AS (SELECT event_id AS seq, user_id + 1000 AS blocks, user_id + 10 AS available, user_id + 60 AS free, 4096 AS block_size FROM events),
       sized AS (SELECT seq, blocks * block_size - (free * block_size - available * block_size) AS totalbytes, available * block_size AS freebytes FROM blocks)
       SELECT seq, totalbytes, freebytes, totalbytes - freebytes AS usedbytes,
              CAST(totalbytes - freebytes AS DOUBLE) / CAST(totalbytes AS DOUBLE) * 100 AS usedpct FROM sized""",
)
def _(t):
    blocks = t.events.selectExpr(
        "event_id AS seq", "user_id + 1000 AS blocks", "user_id + 10 AS available", "user_id + 60 AS free", "4096 AS block_size"
    )
    return N.disk_usage(blocks).select("seq", "totalbytes", "freebytes", "usedbytes", "usedpct")


@query(
    "h12_counter_rates",
    """WITH linked AS (SELECT *, lag(rx_bytes) OVER w AS pb, lag(ts) OVER w AS pt FROM counters WINDOW w AS (PARTITION BY device ORDER BY seq)),
       spent AS (SELECT *, CASE WHEN pb > rx_bytes THEN 4294967296 - pb + rx_bytes ELSE rx_bytes - pb END AS delta,
                        CAST(floor((epoch_us(ts) - epoch_us(pt)) / 1e6) AS BIGINT) AS secs FROM linked)
       SELECT device, seq, ts, rx_bytes, CASE WHEN pb IS NULL THEN 0.0 WHEN secs = 0 THEN NULL
              ELSE CAST(delta AS DOUBLE) / CAST(secs AS DOUBLE) END AS rate FROM spent""",
)
def _(t):
    return N.counter_rates(t.counters, ["device"], "rx_bytes", block_size=BLOCK)


@query(
    "h13_latest_by_feed",
    """SELECT newsgroup, article_number, msg_time, site, props FROM feed
       QUALIFY row_number() OVER (PARTITION BY newsgroup ORDER BY article_number DESC) = 1""",
)
def _(t):
    return H.latest_by_feed(t.feed.select("newsgroup", "article_number", "msg_time", "site", "props"))


@query(
    "h14_latest_with_timeout",
    """SELECT newsgroup, article_number, msg_time FROM feed
       WHERE (SELECT TIMESTAMP '2024-01-31 00:30:00' - max(msg_time) FROM feed) <= INTERVAL 1 DAY
       QUALIFY row_number() OVER (PARTITION BY newsgroup ORDER BY article_number DESC) = 1""",
)
def _(t):
    feed = t.feed.select("newsgroup", "article_number", "msg_time")
    return H.latest_with_timeout(feed, "1 day", "2024-01-31 00:30:00")
