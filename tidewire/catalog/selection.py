"""Feed, file, message and log selection; marks; merging."""

from pyspark.sql import functions as F

from tidewire.catalog import query
from tidewire.operators import marks as M
from tidewire.operators import merge as G
from tidewire.operators import select as S
from tidewire.plans.storage import shared_path
from tidewire.sources.message_table import MessageTable

BLOCK = 1 << 14
PLAIN = ["newsgroup", "article_number", "msg_time"]


def feed(t):
    return t.feed.select(*PLAIN)


def logs(t):
    """The feed as log records: names two or three levels deep, mixed levels."""
    return t.events.selectExpr(
        "event_id AS seq",
        "ts AS asctime",
        "CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'INFO' "
        "WHEN 'signup' THEN 'warning' ELSE 'TRACE' END AS levelname",
        "concat('Group', user_id % 3, CASE WHEN user_id % 2 = 0 THEN '' ELSE '/worker' END, '/', event_type) AS name",
        "props AS message",
    )


_LOGS = """logs AS (
  SELECT event_id AS seq, ts AS asctime,
         CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'DEBUG' WHEN 'view' THEN 'INFO'
              WHEN 'signup' THEN 'warning' ELSE 'TRACE' END AS levelname,
         concat('Group', user_id % 3, CASE WHEN user_id % 2 = 0 THEN '' ELSE '/worker' END, '/', event_type) AS name,
         props AS message FROM events)"""


@query(
    "c1_list_feeds",
    """SELECT newsgroup, min(article_number) AS low, max(article_number) AS high,
              max(article_number) - min(article_number) + 1 AS n_articles
       FROM feed WHERE newsgroup LIKE 'transport.%' AND newsgroup NOT LIKE '%.s%' GROUP BY newsgroup
       UNION ALL SELECT 'transport.demo.idle', NULL, NULL, 0""",
)
def _(t):
    roster = t.spark.createDataFrame([("transport.demo.idle",)], "newsgroup string")
    roster = roster.unionByName(t.feed.select("newsgroup").distinct())
    return S.list_feeds(t.feed, "transport.*", ["*.s*"], roster)


@query(
    "c2_resolve_feeds",
    """SELECT DISTINCT newsgroup FROM feed WHERE regexp_matches(newsgroup, '^transport\\.demo\\..[^.]*$')
         AND newsgroup NOT LIKE '%click'
       UNION SELECT 'no.such.group'""",
)
def _(t):
    return S.resolve_feeds(t.feed, ["transport.demo.?*", "no.such.group"], ["*click"])


@query(
    "c3_filter_feeds",
    """SELECT newsgroup, article_number, msg_time FROM feed
       WHERE (newsgroup LIKE '%.e%' OR newsgroup LIKE '%.view' OR newsgroup LIKE '%.s%') AND newsgroup NOT LIKE '%up'""",
)
def _(t):
    return S.filter_feeds(feed(t), ["*.e*", "*.view", "*.s*"], ["*up"])


@query(
    "c4_filter_filenames",
    """SELECT newsgroup, article_number, filename FROM files
       WHERE (filename LIKE '%.en.txt' OR regexp_matches(filename, '^doc-[0-4].*$')) AND filename NOT LIKE '%.fr.%'""",
)
def _(t):
    files = t.files.select("newsgroup", "article_number", "filename")
    return S.filter_filenames(files, ["*.en.txt", "doc-[0-4]*"], ["*.fr.*"])


@query(
    "c5_filter_mounts",
    "SELECT mount, seq, usedpct FROM usage WHERE mount LIKE '/data/%' AND regexp_matches(mount, '[0-3]$') AND mount <> '/data/d1'",
)
def _(t):
    return S.filter_mounts(t.usage.select("mount", "seq", "usedpct"), ["/data/*", "*[0-3]"], ["/data/d1", "/dev*"])


def with_headers(t):
    headers = F.create_map(F.lit("x-site"), F.col("site"), F.lit("subject"), F.col("props"))
    return t.feed.select(*PLAIN, headers.alias("headers"))


@query(
    "c6_match_headers",
    "SELECT newsgroup, article_number FROM feed WHERE site IN ('site1', 'site2') AND props LIKE '%5}'",
)
def _(t):
    group, variable = {"X-Site": "site9", "Subject": "*5}"}, {"X-Site": "site[12]"}
    return S.match_headers(with_headers(t), group, variable).select("newsgroup", "article_number")


@query(
    "c7_time_range",
    """SELECT newsgroup, article_number, msg_time FROM feed
       WHERE msg_time BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-12 12:30:00'""",
)
def _(t):
    return S.time_range(feed(t), "2024-01-10 00:00:00", "2024-01-12 12:30:00")


RECENT_SQL = "SELECT newsgroup, article_number, msg_time FROM feed WHERE msg_time >= TIMESTAMP '2024-01-31 00:00:00' - INTERVAL 36 HOUR"
RECENT_TO_NEWEST_SQL = """SELECT newsgroup, article_number, msg_time FROM feed
       QUALIFY max(msg_time) OVER (PARTITION BY newsgroup) - msg_time <= INTERVAL 12 HOUR"""


@query("c8_recent", RECENT_SQL)
def _(t):
    return S.recent(feed(t), "36h", "2024-01-31 00:00:00")


@query("c8_recent_to_newest", RECENT_TO_NEWEST_SQL)
def _(t):
    return S.recent_to_newest(feed(t), "12h")


def message_table(t):
    """The feed in a stored table with an index, appended in three batches."""
    table = MessageTable(t.spark, shared_path(t.spark, "messages"), "newsgroup string, article_number bigint, msg_time timestamp_ntz", rows_per_file=1 << 10)
    for batch in range(3):
        table.append(feed(t).filter(F.least(F.floor((F.dayofmonth("msg_time") - 1) / 10), F.lit(2)) == batch), batch)
    return table


@query("c8_recent_indexed", RECENT_SQL)
def _(t):
    return message_table(t).recent("36h", "2024-01-31 00:00:00")


@query("c8_recent_to_newest_indexed", RECENT_TO_NEWEST_SQL)
def _(t):
    return message_table(t).recent_to_newest("12h")


@query(
    "c9_log_name_filter",
    f"""WITH {_LOGS} SELECT seq, name FROM logs
        WHERE CASE WHEN regexp_matches(name, '^Group1/worker/[^/]+$') THEN false
                   WHEN regexp_matches(name, '^Group1/.*$') THEN true
                   WHEN regexp_matches(name, '^[^/]+/error$') THEN true ELSE false END""",
)
def _(t):
    return S.log_name_filter(logs(t), ["!Group1/worker/*", "Group1/**", "*/error"]).select("seq", "name")


@query(
    "c10_log_level",
    f"WITH {_LOGS} SELECT seq, levelname FROM logs WHERE upper(levelname) IN ('ERROR', 'WARNING')",
)
def _(t):
    return S.log_level(logs(t), "warning").select("seq", "levelname")


@query(
    "c11_where_valid",
    "SELECT newsgroup, article_number, upper(site) AS site FROM feed WHERE value > 50",
)
def _(t):
    valid = S.where_valid(t.feed, F.col("value") > 50)
    rewritten = S.where_valid(valid, lambda df: df.withColumn("site", F.upper("site")))
    return rewritten.select("newsgroup", "article_number", "site")


# ------------------------------------------------------------------ marks

_MARKS = """feeds AS (SELECT newsgroup, min(article_number) AS low, max(article_number) AS high FROM feed GROUP BY 1),
marks AS (SELECT newsgroup, CASE newsgroup WHEN 'transport.demo.click' THEN low - 5 WHEN 'transport.demo.view' THEN high + 7
                                           ELSE low + (high - low) // 2 END AS last_read
          FROM feeds WHERE newsgroup <> 'transport.demo.signup')"""


def feeds_and_marks(t):
    """Marks of a reader: half read, except one feed unread, one below and one above what there is."""
    feeds = S.feed_marks(t.feed.select(*PLAIN))
    marks = feeds.filter("newsgroup <> 'transport.demo.signup'").selectExpr(
        "newsgroup",
        "CASE newsgroup WHEN 'transport.demo.click' THEN low - 5 WHEN 'transport.demo.view' THEN high + 7 "
        "ELSE low + (high - low) div 2 END AS last_read",
    )
    return feeds, marks


_EFFECTIVE = """effective AS (
  SELECT f.newsgroup, CASE WHEN last_read >= low - 1 AND last_read <= high THEN last_read ELSE low - 1 END AS mark
  FROM feeds f LEFT JOIN marks USING (newsgroup))"""


UNREAD_SQL = f"""WITH {_MARKS}, {_EFFECTIVE}
        SELECT newsgroup, article_number, msg_time FROM feed JOIN effective USING (newsgroup) WHERE article_number > mark"""


@query("d1_unread", UNREAD_SQL)
def _(t):
    return M.unread(feed(t), feeds_and_marks(t)[1])


@query("d1_unread_indexed", UNREAD_SQL)
def _(t):
    return message_table(t).unread(feeds_and_marks(t)[1])


@query(
    "d2_catch_up",
    f"""WITH {_MARKS}, known AS (SELECT f.newsgroup, low, high, coalesce(last_read, low - 1) AS cur
                                 FROM feeds f LEFT JOIN marks USING (newsgroup))
        SELECT 'keep' AS rule, newsgroup, cur AS last_read FROM known
        UNION ALL SELECT 'all', newsgroup, high FROM known
        UNION ALL SELECT 'newest', newsgroup, greatest(cur, high - 10) FROM known
        UNION ALL SELECT 'reset', newsgroup, greatest(0, high - 10) FROM known""",
)
def _(t):
    feeds, marks = feeds_and_marks(t)
    rules = [("keep", 0, False), ("all", 1, False), ("newest", -10, False), ("reset", -10, True)]
    out = None
    for name, n, reset in rules:
        part = M.catch_up(feeds, marks, n, reset).withColumn("rule", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "d3_last_n",
    """SELECT newsgroup, article_number, msg_time FROM feed
       QUALIFY row_number() OVER (PARTITION BY newsgroup ORDER BY article_number DESC) <= 25""",
)
def _(t):
    return M.last_n(feed(t), 25)


@query(
    "d3_next_unread",
    f"""WITH {_MARKS}, {_EFFECTIVE}
        SELECT newsgroup, min(article_number) AS article_number FROM feed JOIN effective USING (newsgroup)
        WHERE article_number > mark GROUP BY 1""",
)
def _(t):
    return M.next_unread(feed(t), feeds_and_marks(t)[1]).select("newsgroup", "article_number")


@query(
    "d4_advance_marks",
    f"""WITH {_MARKS}, done AS (SELECT newsgroup, max(article_number) AS done FROM feed GROUP BY 1)
        SELECT 'main' AS reader, newsgroup, greatest(last_read, done) AS last_read
        FROM marks FULL JOIN done USING (newsgroup)""",
)
def _(t):
    done = feed(t).withColumn("reader", F.lit("main"))
    return M.advance_marks(done, feeds_and_marks(t)[1].withColumn("reader", F.lit("main")))


# ---------------------------------------------------------------- merging

MERGED = [f"transport.demo.{kind}" for kind in ("view", "error", "click", "signup", "purchase")]


MERGED_SQL = """SELECT newsgroup, article_number, msg_time,
              max(msg_time) OVER (PARTITION BY newsgroup ORDER BY article_number ROWS UNBOUNDED PRECEDING) AS merge_time,
              CASE newsgroup WHEN 'transport.demo.view' THEN 0 WHEN 'transport.demo.error' THEN 1 WHEN 'transport.demo.click' THEN 2
                             WHEN 'transport.demo.signup' THEN 3 ELSE 4 END AS feed_index
       FROM late_feed"""


@query("g1_sync_merge", MERGED_SQL)
def _(t):
    return G.sync_merge(t.late_feed.select(*PLAIN), MERGED, BLOCK * 100)


def log_files(t):
    """The records as if the events of each of three users' groups had a file of their own."""
    return logs(t).withColumn("path", F.substring_index("name", "/", 1)).withColumn("record_no", F.col("seq"))


@query("g2_merge_logs", f"WITH {_LOGS} SELECT *, row_number() OVER (ORDER BY asctime, split_part(name, '/', 1), seq) AS rank FROM logs")
def _(t):
    return G.ranked(G.merge_logs(log_files(t))).drop("path", "record_no")


@query(
    "g3_tail_logs",
    f"""WITH {_LOGS}, ends AS (SELECT *, row_number() OVER (ORDER BY asctime DESC, split_part(name, '/', 1) DESC, seq DESC) AS back FROM logs WHERE upper(levelname) = 'ERROR')
        SELECT * EXCLUDE (back), max(back) OVER () + 1 - back AS rank FROM ends WHERE back <= 30""",
)
def _(t):
    return G.ranked(G.tail_logs(S.log_level(log_files(t), "error"), 30)).drop("path", "record_no")


@query(
    "g4_rank_feeds",
    """SELECT newsgroup, min(article_number) AS low, max(article_number) AS high,
              max(article_number) - min(article_number) + 1 AS n_articles,
              row_number() OVER (ORDER BY max(article_number) - min(article_number) DESC, newsgroup DESC) AS rank
       FROM feed GROUP BY newsgroup""",
)
def _(t):
    return G.ranked(G.rank_feeds(S.list_feeds(t.feed), "count", reverse=True))
