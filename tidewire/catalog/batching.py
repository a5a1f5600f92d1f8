"""Batches of a feed: cutting, reports, retention."""

from pyspark.sql import functions as F

from tidewire.catalog import query
from tidewire.operators import batches as B

GAP = "1h"
_GAP_SQL = "INTERVAL 1 HOUR"
BLOCK = 1 << 14  # block size of the event feeds: a block is a task-sized piece at sf0.1

# Batches of the feed by a one-hour gap; batch_id is the first article of the batch.
GAP_BATCHES = f"""
flagged AS (
  SELECT *, lag(msg_time) OVER (PARTITION BY newsgroup ORDER BY article_number) AS prev_time FROM feed),
batched AS (
  SELECT *, max(CASE WHEN prev_time IS NULL OR msg_time - prev_time >= {_GAP_SQL} THEN article_number END)
         OVER (PARTITION BY newsgroup ORDER BY article_number ROWS UNBOUNDED PRECEDING) AS batch_id
  FROM flagged),
batch AS (
  SELECT newsgroup, batch_id, arg_min(msg_time, article_number) AS start_time,
         arg_max(msg_time, article_number) AS last_time, count(*) AS n_msgs,
         CAST(sum(n_bytes) AS BIGINT) AS n_bytes
  FROM batched GROUP BY newsgroup, batch_id),
closed AS (
  SELECT *, lead(start_time) OVER (PARTITION BY newsgroup ORDER BY batch_id) AS close_time,
         row_number() OVER (PARTITION BY newsgroup ORDER BY batch_id DESC) AS recent
  FROM batch)"""


def gap_batches(t):
    feed = t.feed.select("newsgroup", "article_number", "msg_time", "n_bytes")
    return B.batch_by_gap(feed, GAP, BLOCK, narrow=True)


@query("f1_batch_by_gap", f"WITH {GAP_BATCHES} SELECT newsgroup, article_number, msg_time, batch_id FROM batched")
def _(t):
    return B.batch_by_gap(t.feed.select("newsgroup", "article_number", "msg_time"), GAP, BLOCK, narrow=True)


@query(
    "f1_batch_by_gap_late",
    """WITH flagged AS (
         SELECT *, lag(msg_time) OVER (PARTITION BY newsgroup ORDER BY article_number) AS prev_time FROM late_feed)
       SELECT newsgroup, article_number, msg_time,
              max(CASE WHEN prev_time IS NULL OR msg_time - prev_time >= INTERVAL 1 HOUR THEN article_number END)
              OVER (PARTITION BY newsgroup ORDER BY article_number ROWS UNBOUNDED PRECEDING) AS batch_id
       FROM flagged""",
)
def _(t):
    feed = t.late_feed.select("newsgroup", "article_number", "msg_time")
    return B.batch_by_gap(feed, GAP, BLOCK * 100, narrow=True)


@query(
    "f2_batch_by_span",
    """SELECT newsgroup, CAST(floor(epoch_us(msg_time) / 86400000000) AS BIGINT) AS batch_id,
              min(msg_time) AS start_time, max(msg_time) AS last_time, count(*) AS n_msgs,
              CAST(sum(n_bytes) AS BIGINT) AS n_bytes
       FROM feed GROUP BY 1, 2""",
)
def _(t):
    return B.batch_table(B.batch_by_span(t.feed, "1 day", ordered=True))


@query(
    "f2_batch_by_span_late",
    """WITH spans AS (SELECT *, floor(epoch_us(msg_time) / 21600000000) AS span FROM late_feed),
       flagged AS (SELECT *, lag(span) OVER (PARTITION BY newsgroup ORDER BY article_number) AS prev FROM spans)
       SELECT newsgroup, article_number,
              max(CASE WHEN prev IS NULL OR prev <> span THEN article_number END)
              OVER (PARTITION BY newsgroup ORDER BY article_number ROWS UNBOUNDED PRECEDING) AS batch_id
       FROM flagged""",
)
def _(t):
    feed = t.late_feed.select("newsgroup", "article_number", "msg_time")
    return B.batch_by_span(feed, "6h", block_size=BLOCK * 100).drop("msg_time")


@query(
    "f3_batch_by_count",
    """SELECT newsgroup, article_number,
              CAST((row_number() OVER (PARTITION BY newsgroup ORDER BY article_number) - 1) // 50 AS BIGINT) AS batch_id
       FROM feed""",
)
def _(t):
    return B.batch_by_count(t.feed.select("newsgroup", "article_number"), 50, BLOCK)


@query(
    "f4_sample_span",
    """SELECT newsgroup, article_number, msg_time FROM (
         SELECT *, row_number() OVER (PARTITION BY newsgroup, floor(epoch_us(msg_time) / 3600000000)
                                      ORDER BY article_number) AS rn FROM feed)
       WHERE rn <= 2""",
)
def _(t):
    feed = t.feed.select("newsgroup", "article_number", "msg_time")
    return B.sample_span(feed, "1h", 2, ordered=True).drop("batch_id")


@query(
    "f4_sample_span_late",
    """WITH spans AS (SELECT *, floor(epoch_us(msg_time) / 21600000000) AS span FROM late_feed),
       flagged AS (SELECT *, lag(span) OVER (PARTITION BY newsgroup ORDER BY article_number) AS prev FROM spans),
       runs AS (SELECT *, max(CASE WHEN prev IS NULL OR prev <> span THEN article_number END)
                OVER (PARTITION BY newsgroup ORDER BY article_number ROWS UNBOUNDED PRECEDING) AS run FROM flagged)
       SELECT newsgroup, article_number, msg_time FROM (
         SELECT *, row_number() OVER (PARTITION BY newsgroup, run ORDER BY article_number) AS rn FROM runs)
       WHERE rn <= 3""",
)
def _(t):
    feed = t.late_feed.select("newsgroup", "article_number", "msg_time")
    return B.sample_span(feed, "6h", 3, block_size=BLOCK * 100).drop("batch_id")


@query(
    "f5_close_on_timeout",
    f"""WITH {GAP_BATCHES}
        SELECT newsgroup, batch_id, start_time, last_time, n_msgs, n_bytes,
               CASE WHEN recent > 1 OR TIMESTAMP '2024-01-31 00:15:00' - last_time >= INTERVAL 1 HOUR
                    THEN 'Time out reached' END AS reason
        FROM closed""",
)
def _(t):
    now = F.lit("2024-01-31 00:15:00").cast("timestamp_ntz")
    feed = t.feed.select("newsgroup", "article_number", "msg_time", "n_bytes")
    return B.close_on_timeout(feed, GAP, now, block_size=BLOCK)


_F6_CLOSED = """
WITH ranged AS (
  SELECT *, msg_time >= TIMESTAMP '2024-01-03 00:00:00' AND msg_time <= TIMESTAMP '2024-01-28 12:00:00' AS in_range,
         floor(epoch_us(msg_time) / 3600000000) AS span
  FROM late_feed),
flagged AS (
  SELECT *, lag(span) OVER w AS prev_span, lag(in_range) OVER w AS prev_in
  FROM ranged WINDOW w AS (PARTITION BY newsgroup ORDER BY article_number)),
runs AS (
  SELECT *, max(CASE WHEN prev_span IS NULL OR prev_span <> span OR NOT in_range OR NOT prev_in THEN article_number END)
         OVER (PARTITION BY newsgroup ORDER BY article_number ROWS UNBOUNDED PRECEDING) AS run
  FROM flagged),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY newsgroup, run ORDER BY article_number) AS rn FROM runs)
SELECT newsgroup, article_number, msg_time, n_bytes,
       CASE WHEN NOT in_range THEN 'out_of_range' WHEN rn > 4 THEN 'rejected' ELSE 'saved' END AS action,
       CASE WHEN in_range AND rn <= 4 THEN run END AS batch_id
FROM numbered"""


@query("f6_batch_feed_span_count", _F6_CLOSED)
def _(t):
    options = B.BatchOptions(span="1h", max_messages=4, start="2024-01-03 00:00:00", stop="2024-01-28 12:00:00")
    return B.batch_feed(t.late_feed, options, block_size=BLOCK * 100)


# Gap, span and count together: the rule is a recursion from message to message.
_F6_MIXED = """
WITH RECURSIVE numbered AS (
  SELECT newsgroup, article_number, msg_time, n_bytes, epoch_us(msg_time) AS t,
         row_number() OVER (PARTITION BY newsgroup ORDER BY article_number) AS rn
  FROM late_feed),
walk AS (
  SELECT newsgroup, rn, article_number, msg_time, n_bytes, 'saved' AS action,
         article_number AS batch_id, article_number AS open_id, 1 AS n, t AS last_t
  FROM numbered WHERE rn = 1
  UNION ALL
  SELECT s.newsgroup, s.rn, s.article_number, s.msg_time, s.n_bytes,
         CASE WHEN s.opens OR s.n < 3 THEN 'saved' ELSE 'rejected' END,
         CASE WHEN s.opens THEN s.article_number WHEN s.n < 3 THEN s.open_id END,
         CASE WHEN s.opens THEN s.article_number ELSE s.open_id END,
         CASE WHEN s.opens THEN 1 WHEN s.n < 3 THEN s.n + 1 ELSE s.n END,
         CASE WHEN s.opens OR s.n < 3 THEN s.t ELSE s.last_t END
  FROM (SELECT m.*, w.n, w.last_t, w.open_id,
               m.t - w.last_t >= 1800000000 OR floor(m.t / 14400000000) <> floor(w.last_t / 14400000000) AS opens
        FROM walk w JOIN numbered m ON m.newsgroup = w.newsgroup AND m.rn = w.rn + 1) s)
SELECT newsgroup, article_number, msg_time, n_bytes, action, batch_id FROM walk"""


@query("f6_batch_feed_mixed", _F6_MIXED)
def _(t):
    options = B.BatchOptions(gap="30m", span="4h", max_messages=3)
    return B.batch_feed(t.late_feed, options, block_size=BLOCK * 100)


FEED_REPORT_SQL = (
    _F6_MIXED.replace("AS n, t AS last_t", "AS n, t AS last_t, NULL::VARCHAR AS reason, article_number AS was_open")
    .replace("ELSE s.last_t END\n", "ELSE s.last_t END, s.reason, s.was_open\n")
    .replace(
        "AS opens\n",
        "AS opens, w.open_id AS was_open, CASE WHEN m.t - w.last_t >= 1800000000 THEN 'Time gap' "
        "WHEN floor(m.t / 14400000000) <> floor(w.last_t / 14400000000) THEN 'Time span' END AS reason\n",
    )
    .replace(
        "SELECT newsgroup, article_number, msg_time, n_bytes, action, batch_id FROM walk",
        """SELECT b.newsgroup, b.batch_id, start_time, last_time, n_msgs, n_bytes, reason FROM (
             SELECT newsgroup, batch_id, arg_min(msg_time, article_number) AS start_time, arg_max(msg_time, article_number) AS last_time,
                    count(*) AS n_msgs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM walk WHERE batch_id IS NOT NULL GROUP BY 1, 2) b
           LEFT JOIN (SELECT newsgroup, was_open AS batch_id, arg_min(reason, article_number) AS reason FROM walk WHERE reason IS NOT NULL GROUP BY 1, 2) c
           ON b.newsgroup = c.newsgroup AND b.batch_id = c.batch_id""",
    )
)


@query("f7_feed_report", FEED_REPORT_SQL)
def _(t):
    options = B.BatchOptions(gap="30m", span="4h", max_messages=3)
    return B.feed_report(B.batch_feed(t.late_feed, options, block_size=BLOCK * 100), options, BLOCK * 100)


@query(
    "f7_batch_report",
    f"""WITH {GAP_BATCHES}
        SELECT newsgroup, batch_id, start_time, last_time, n_msgs, n_bytes,
               CASE WHEN recent > 1 THEN 'Time gap' END AS reason
        FROM closed""",
)
def _(t):
    feed = t.feed.select("newsgroup", "article_number", "msg_time", "n_bytes")
    return B.batch_report(B.batch_by_gap(feed, GAP, BLOCK, mark_newest=True, narrow=True), "Time gap")


def batched_files(t):
    """Batches of the feed, each message archived under its site."""
    feed = t.feed.selectExpr("newsgroup", "article_number", "msg_time", "n_bytes", "concat(site, '.dat') AS dest")
    return B.batch_by_gap(feed, GAP, BLOCK, mark_newest=True, narrow=True)


_STATS_SQL = """
stats AS (
  SELECT newsgroup, batch_id, concat(site, '.dat') AS dest, count(*) AS n_msgs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes
  FROM batched GROUP BY 1, 2, 3)"""
_SIZE_SQL = "CASE WHEN {n} < 1023.95 THEN format('{{:.1f}} B', {n} * 1.0) ELSE format('{{:.1f}} KiB', {n} / 1024.0) END"


@query("f15_file_stats", f"WITH {GAP_BATCHES}, {_STATS_SQL} SELECT * FROM stats")
def _(t):
    return B.file_stats(batched_files(t))


_TIME_SQL = "concat(strftime({0}, '%a %b '), lpad(CAST(day({0}) AS VARCHAR), 2, ' '), strftime({0}, ' %H:%M:%S %Y UTC +0000'))"


@query(
    "f7_batch_report_lines",
    f"""WITH {GAP_BATCHES}, {_STATS_SQL},
        lines AS (
          SELECT newsgroup, batch_id, 0 AS part, '' AS dest, unnest(range(12)) AS line_no,
                 unnest([repeat('_', 75), 'Archive report', '',
                   concat('    Newsgroup     : ', newsgroup),
                   concat('    Beginning     : ', {_TIME_SQL.format('start_time')}),
                   concat('    Ending        : ', {_TIME_SQL.format('last_time')}),
                   concat('    Messages      : ', n_msgs),
                   concat('    Total bytes   : ', {_SIZE_SQL.format(n='n_bytes')}),
                   concat('    Reason        : ', CASE WHEN recent > 1 THEN 'Time gap' ELSE '' END),
                   '', '    Filenames', '    ---------']) AS line FROM closed
          UNION ALL
          SELECT newsgroup, batch_id, 1, dest, 0, concat('    ', dest, ': ', {_SIZE_SQL.format(n='n_bytes')}, ' (', n_msgs,
                   CASE WHEN n_msgs > 1 THEN ' msgs)' ELSE ' msg)' END) FROM stats
          UNION ALL
          SELECT newsgroup, batch_id, 2, '', 0, repeat('_', 75) FROM closed)
        SELECT * FROM lines""",
)
def _(t):
    batched = batched_files(t)
    return B.batch_report_lines(B.batch_report(batched, "Time gap"), B.file_stats(batched), "Archive report")


_PERIOD_SQL = "make_timestamp(CAST(floor((epoch_us(close_time) - 21600000000) / 86400000000) AS BIGINT) * 86400000000 + 21600000000)"


@query(
    "f8_summary_report",
    f"""WITH {GAP_BATCHES}
        SELECT newsgroup, {_PERIOD_SQL} AS period_start, count(*) AS n_batches,
               CAST(sum(n_msgs) AS BIGINT) AS n_msgs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes
        FROM closed WHERE close_time IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    closed = B.closing_times(B.batch_table(gap_batches(t)), BLOCK)
    return B.summary_report(closed, "1 day", "6h")


@query(
    "f8_summary_files",
    f"""WITH {GAP_BATCHES}, {_STATS_SQL},
        ranked AS (
          SELECT newsgroup, batch_id, {_PERIOD_SQL} AS period_start,
                 row_number() OVER (PARTITION BY newsgroup, {_PERIOD_SQL} ORDER BY batch_id DESC) AS recency
          FROM closed WHERE close_time IS NOT NULL)
        SELECT newsgroup, batch_id, period_start, recency, dest, n_msgs, n_bytes
        FROM ranked JOIN stats USING (newsgroup, batch_id) WHERE recency <= 2""",
)
def _(t):
    batched = batched_files(t)
    closed = B.closing_times(B.batch_table(batched), BLOCK)
    listed = B.summary_files(closed, "1 day", "6h", max_files=2)
    picked = listed.select("newsgroup", "batch_id", "period_start", "recency")
    return B.file_stats(batched).join(picked, ["newsgroup", "batch_id"])


@query(
    "f8_summary_lines",
    f"""WITH {GAP_BATCHES}, {_STATS_SQL},
        ranked AS (
          SELECT *, {_PERIOD_SQL} AS period_start,
                 row_number() OVER (PARTITION BY newsgroup, {_PERIOD_SQL} ORDER BY batch_id DESC) AS recency
          FROM closed WHERE close_time IS NOT NULL),
        summary AS (
          SELECT newsgroup, period_start, CAST(sum(n_msgs) AS BIGINT) AS n_msgs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes
          FROM ranked GROUP BY 1, 2),
        listed AS (
          SELECT r.newsgroup, r.period_start, r.recency, s.dest, s.n_msgs, s.n_bytes,
                 s.dest = min(s.dest) OVER (PARTITION BY r.newsgroup, r.batch_id) AS leads
          FROM ranked r JOIN stats s USING (newsgroup, batch_id) WHERE r.recency <= 1000),
        lines AS (
          SELECT newsgroup, period_start, 0 AS part, 0 AS recency, '' AS dest, unnest(range(11)) AS line_no,
                 unnest([repeat('_', 75), 'Archive summary', '',
                   concat('    Newsgroup     : ', newsgroup),
                   concat('    Beginning     : ', {_TIME_SQL.format('period_start')}),
                   concat('    Ending        : ', {_TIME_SQL.format("(period_start + INTERVAL 1 DAY)")}),
                   concat('    Messages      : ', n_msgs),
                   concat('    Total bytes   : ', {_SIZE_SQL.format(n='n_bytes')}),
                   '', '    Filenames', '    ---------']) AS line FROM summary
          UNION ALL
          SELECT newsgroup, period_start, 1, recency, dest, 0,
                 concat(CASE WHEN leads THEN '  - ' ELSE '    ' END, dest, ': ', {_SIZE_SQL.format(n='n_bytes')}, ' (', n_msgs,
                   CASE WHEN n_msgs > 1 THEN ' msgs)' ELSE ' msg)' END) FROM listed
          UNION ALL
          SELECT newsgroup, period_start, 2, 0, '', 0, repeat('_', 75) FROM summary)
        SELECT * FROM lines""",
)
def _(t):
    batched = batched_files(t)
    closed = B.closing_times(B.batch_table(batched), BLOCK)
    return B.summary_lines(
        B.summary_report(closed, "1 day", "6h"), B.summary_files(closed, "1 day", "6h"), B.file_stats(batched),
        "Archive summary", "1 day",
    )


@query(
    "f9_keep_history",
    f"""WITH {GAP_BATCHES}
        SELECT newsgroup, batch_id, start_time, last_time, n_msgs, n_bytes, recent - 1 AS history_index
        FROM closed WHERE recent <= 6""",
)
def _(t):
    return B.keep_history(B.batch_table(gap_batches(t)), 5)


@query(
    "f10_expire",
    f"""WITH {GAP_BATCHES}, examined AS (
          SELECT *, TIMESTAMP '2024-01-31 00:00:00' - last_time > INTERVAL 3 DAY AS old
          FROM closed WHERE recent > 1 AND recent <= 22),
        walked AS (
          SELECT *, bool_and(old) OVER (PARTITION BY newsgroup ORDER BY batch_id ROWS UNBOUNDED PRECEDING) AS gone
          FROM examined)
        SELECT newsgroup, batch_id, start_time, last_time, n_msgs, n_bytes FROM walked WHERE gone""",
)
def _(t):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    return B.expire(B.batch_table(gap_batches(t)), "3 days", now, history=20)
