"""Streams over the given tables: each table arrives in three steps, written by Spark to the
shared folder, and the query goes on from its checkpoint after each."""

from pyspark.sql import functions as F

from tidewire.catalog import query
from tidewire.catalog.batching import _F6_MIXED, FEED_REPORT_SQL
from tidewire.catalog.intake import LOGS_SQL, SPOOL_SQL, log_lines, log_tree, spool_rows, text_messages, written
from tidewire.catalog.payloads import J2_SQL, J3_TREE_SQL, header_checks, page_contents, split_messages
from tidewire.catalog.payloads import messages as relay_messages
from tidewire.catalog.selection import MERGED, MERGED_SQL, PLAIN
from tidewire.catalog.series import END, I4_LAST_SQL, I4_MAX_SQL, I7_SQL, PERIODS, rounded
from tidewire.operators.batches import BatchOptions
from tidewire.operators.relay import content_digests, header_digest
from tidewire.plans.storage import shared_path, stage
from tidewire.sinks.posts import write_spool
from tidewire.sinks.raw import open_root
from tidewire.sources.log_ranges import follow_logs
from tidewire.sources.logs import read_logs
from tidewire.sources.spool_stream import stream_spool
from tidewire.streaming.archive import StreamArchive, StreamJoin
from tidewire.streaming.changes import StreamChanges
from tidewire.streaming.commits import ArchiveLog
from tidewire.streaming.epochs import EpochTable, run_batches
from tidewire.streaming.flows import LOGS, StreamLogs, stream_relay
from tidewire.streaming.merge import StreamMerge
from tidewire.streaming.pyramid import SeriesPyramid
from tidewire.streaming.status import StreamLatest, StreamStates, StreamStatus, stream_status
from tidewire.streaming.windows import OnTime, append_final, period_counts, sessions

BLOCK = 1 << 14
STEPS = 3


def arrive(table, step_of, root, step):
    """Append one step of a table to a folder the stream watches."""
    table.filter(step_of == step).write.mode("append").parquet(root)


def replay(t, table, step_of, start):
    """Let a table arrive step by step; ``start(stream)`` starts a query on what is there."""
    root = shared_path(t.spark, "arrivals")
    for step in range(STEPS):
        arrive(table, step_of, root, step)
        start(t.spark.readStream.schema(table.schema).parquet(root)).awaitTermination()


def thirds(column):
    """Step by day of the month: days 1-10, 11-20, the rest."""
    return F.least(F.floor((F.dayofmonth(column) - 1) / 10), F.lit(STEPS - 1))


@query("l1_stream_archive", _F6_MIXED)
def _(t):
    root = shared_path(t.spark, "archive")
    options = BatchOptions(gap="30m", span="4h", max_messages=3)
    archive = StreamArchive(t.spark, root, options, block_size=BLOCK * 100)
    feed = t.late_feed.select("newsgroup", "article_number", "msg_time", "n_bytes")
    # steps by article number: a feed arrives in its own order
    step = F.least(F.floor(F.col("article_number") / (BLOCK * 20)), F.lit(STEPS - 1))
    replay(t, feed, step, lambda s: run_batches(s, archive.apply, f"{root}/checkpoint"))
    return archive.messages.all().select("newsgroup", "article_number", "msg_time", "n_bytes", "action", "batch_id")


def archived(t, log=None):
    """The whole late feed, archived in steps; with a log, the file of each message into one per site."""
    root = shared_path(t.spark, "archive")
    options = BatchOptions(gap="30m", span="4h", max_messages=3)
    archive = StreamArchive(t.spark, root, options, block_size=BLOCK * 100, log=log and log(root))
    extra = ["concat(site, '.dat') AS dest", "0 AS part_no", "CAST(props AS BINARY) AS content"] if log else []
    feed = t.late_feed.selectExpr("newsgroup", "article_number", "msg_time", "n_bytes", *extra)
    step = F.least(F.floor(F.col("article_number") / (BLOCK * 20)), F.lit(STEPS - 1))
    replay(t, feed, step, lambda s: run_batches(s, archive.apply, f"{root}/checkpoint"))
    return archive, root


@query("l1_stream_reports", f"SELECT * FROM ({FEED_REPORT_SQL}) WHERE reason IS NOT NULL")
def _(t):
    archive, _ = archived(t)
    return archive.reports.all().drop("epoch")


@query(
    "l1_stream_files",
    f"""WITH placed AS ({_F6_MIXED}),
        named AS (SELECT p.newsgroup, p.article_number, p.batch_id, f.site, f.props,
                         max(p.batch_id) OVER (PARTITION BY p.newsgroup, f.site) AS last
                  FROM placed p JOIN late_feed f ON p.newsgroup = f.newsgroup AND p.article_number = f.article_number
                  WHERE p.batch_id IS NOT NULL)
        SELECT concat(newsgroup, '/', site, '.dat') AS dest, md5(string_agg(props, '' ORDER BY article_number)) AS digest,
               CAST(sum(octet_length(encode(props))) AS BIGINT) AS n_bytes
        FROM named WHERE batch_id = last GROUP BY 1""",
)
def _(t):
    archive, root = archived(t, lambda root: ArchiveLog(t.spark, f"{root}/log", max_messages=3, chunk_bytes=100, block_size=BLOCK * 100))
    stage(archive.log.publish(f"{root}/published"), "published")
    there = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{root}/published")
    dest = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return there.select(dest.alias("dest"), F.md5("content").alias("digest"), F.col("length").alias("n_bytes"))


@query(
    "l2_stream_states",
    """WITH flagged AS (SELECT *, lag(state) OVER w AS prev FROM observations WINDOW w AS (PARTITION BY member ORDER BY seq)),
       starts AS (SELECT member, seq, ts, state, coalesce(prev, 'unknown') AS previous_state FROM flagged WHERE prev IS DISTINCT FROM state),
       linked AS (SELECT *, coalesce(lag(ts) OVER (PARTITION BY member ORDER BY seq), ts) AS previous_start FROM starts)
       SELECT *, (epoch_us(ts) - epoch_us(previous_start)) / 1e6 AS elapsed FROM linked""",
)
def _(t):
    root = shared_path(t.spark, "states")
    states = StreamStates(t.spark, root, BLOCK)
    replay(t, t.observations, thirds("ts"), lambda s: run_batches(s, states.apply, f"{root}/checkpoint"))
    return states.changes.all().drop("epoch")


@query(
    "l2_stream_status",
    """SELECT newsgroup, 'online' AS status, 'unknown' AS previous_status, false AS changed, epoch_us(min(msg_time)) AS start_us,
              epoch_us(max(msg_time)) AS stop_us, count(*) AS n
       FROM feed WHERE day(msg_time) <= 10 GROUP BY newsgroup""",
)
def _(t):
    root = shared_path(t.spark, "status")
    table = EpochTable(t.spark, f"{root}/out", "newsgroup string, status string, previous_status string, changed boolean, start_us bigint, stop_us bigint, n bigint")

    def start(stream):
        # no feed is quiet for a day of processing time, so each comes online once
        changes = stream_status(stream, "1 day")
        return run_batches(changes, lambda df, epoch: table.write(df, epoch) and None, f"{root}/checkpoint", once=True)

    replay(t, t.feed.select("newsgroup", "msg_time"), thirds("msg_time"), start)
    return table.all().drop("epoch")


# feeds with a c in their names say nothing in the middle third of a month
_QUIET = "newsgroup NOT LIKE '%c%' OR day(msg_time) NOT BETWEEN 11 AND 20"


@query(
    "l2_stream_turns",
    f"""WITH stepped AS (SELECT newsgroup, msg_time, least((day(msg_time) - 1) // 10, 2) AS step FROM feed WHERE {_QUIET}),
       seen AS (SELECT newsgroup, step, min(msg_time) AS first, max(msg_time) AS last, count(*) AS n FROM stepped GROUP BY 1, 2),
       came AS (SELECT *, step - lag(step) OVER w > 1 AS back, lag(step) OVER w IS NULL AS known, max(last) OVER w AS stop,
                       lag(last) OVER w AS before, sum(n) OVER w AS total
                FROM seen WINDOW w AS (PARTITION BY newsgroup ORDER BY step)),
       runs AS (SELECT *, max(CASE WHEN known OR back THEN first END) OVER (PARTITION BY newsgroup ORDER BY step) AS start,
                       coalesce(lead(step) OVER (PARTITION BY newsgroup ORDER BY step), 3) - step > 1 AS quiet FROM came)
       SELECT newsgroup, 'online' AS status, CASE WHEN back THEN 'offline' ELSE 'unknown' END AS previous_status, coalesce(back, false) AS changed,
              first AS change_time, first AS start_time, stop AS stop_time, CAST(NULL AS DOUBLE) AS run_time,
              CASE WHEN back THEN (epoch_us(first) - epoch_us(before)) / 1e6 END AS off_time, CAST(total AS BIGINT) AS n
       FROM runs WHERE known OR back
       UNION ALL
       SELECT newsgroup, 'offline', 'online', true, stop, start, stop, (epoch_us(stop) - epoch_us(start)) / 1e6, NULL, CAST(total AS BIGINT)
       FROM runs WHERE quiet""",
)
def _(t):
    root = shared_path(t.spark, "turns")
    clock = iter(range(0, 1000, 100))
    status = StreamStatus(t.spark, root, timeout=50, now=lambda: float(next(clock)))
    feed = t.feed.select("newsgroup", "msg_time").filter(_QUIET)
    replay(t, feed, thirds("msg_time"), lambda s: run_batches(s, status.apply, f"{root}/checkpoint"))
    return status.turns.all().drop("epoch")


@query(
    "l3_stream_join_parts",
    """SELECT newsgroup, filename, md5(content_text) AS digest, n_bytes, 'ok' AS status FROM files""",
)
def _(t):
    root = shared_path(t.spark, "join")
    join = StreamJoin(t.spark, root, block_size=BLOCK * 100000)
    parts = split_messages(t).select("newsgroup", "filename", "original", "article_number", "part_no", "n_parts", "checksum", "content")
    # every file is spread over the steps
    step = F.least(F.col("part_no"), F.lit(STEPS - 1))
    replay(t, parts, step, lambda s: run_batches(s, join.apply, f"{root}/checkpoint"))
    return join.completed().select(
        "newsgroup", "filename", F.md5("content").alias("digest"), F.octet_length("content").cast("bigint").alias("n_bytes"), "status"
    )


@query(
    "l4_stream_latest",
    """SELECT newsgroup, article_number, msg_time, site FROM feed
       QUALIFY row_number() OVER (PARTITION BY newsgroup ORDER BY article_number DESC) = 1""",
)
def _(t):
    root = shared_path(t.spark, "latest")
    schema = "newsgroup string, article_number bigint, msg_time timestamp_ntz, site string"
    latest = StreamLatest(t.spark, root, schema, timeout="1 day")
    feed = t.feed.select("newsgroup", "article_number", "msg_time", "site")
    replay(t, feed, thirds("msg_time"), lambda s: run_batches(s, latest.apply, f"{root}/checkpoint"))
    return latest.current(STEPS - 1).drop("poll_time")


@query(
    "l5_stream_logs",
    f"SELECT asctime, levelname, name, message, exc_info FROM ({LOGS_SQL}) WHERE levelname = 'ERROR' AND (name LIKE 'Group1/%' OR name LIKE '%/error')",
)
def _(t):
    root = shared_path(t.spark, "follow")
    logs = StreamLogs(t.spark, root, ["Group1/*", "*/error", "!**"], "error")
    run_batches(read_logs(t.spark, log_tree(t), stream=True), logs.apply, f"{root}/checkpoint").awaitTermination()
    return logs.merged.all().select("asctime", "levelname", "name", "message", "exc_info")


def append_lines(lines, root):
    """Append ``line`` to the file ``dest`` of each row; a file's lines by ``event_id``, in one task."""

    def run(frames):
        fs, base = open_root(root)
        for frame in frames:
            for dest, rows in frame.groupby("dest", sort=False):
                fs.create_dir(f"{base}/{dest.rpartition('/')[0]}", recursive=True)
                with fs.open_append_stream(f"{base}/{dest}") as out:
                    out.write("".join(line + "\n" for line in rows["line"]).encode())
            yield frame[["event_id"]]

    dealt = lines.repartition("dest").sortWithinPartitions("dest", "event_id")
    written(dealt.mapInPandas(run, "event_id bigint"))


@query("l5_follow_logs", LOGS_SQL)
def _(t):
    root = shared_path(t.spark, "growing")
    text, json = log_lines()
    dest = "concat(if(event_id % 2 = 0, 'text/', 'json/'), user_id % 16, '.log') AS dest"
    lines = t.events.selectExpr("event_id", "ts", dest, f"if(event_id % 2 = 0, {text}, {json}) AS line")
    table = EpochTable(t.spark, f"{root}/out", LOGS)
    for step in range(STEPS):
        append_lines(lines.filter(thirds("ts") == step), f"{root}/logs")
        # the last poll finds the files quiet
        stream = follow_logs(t.spark, f"{root}/logs", range_bytes=BLOCK, quiet=3600 if step < STEPS - 1 else 0)
        run_batches(stream, lambda df, epoch: table.write(df, epoch) and None, f"{root}/checkpoint").awaitTermination()
    return table.all().select("asctime", "levelname", "name", "message", "exc_info", F.col("threadName").alias("thread"))


@query("l6_stream_relay", "SELECT 'transport.relay' AS newsgroup, article_number, msg_time, site, props AS subject FROM feed WHERE article_number % 10 <> 3")
def _(t):
    root = shared_path(t.spark, "relay")
    valid = F.col("article_number") % 10 != 3
    replay(
        t, relay_messages(t), thirds("msg_time"),
        lambda s: stream_relay(s, "transport.relay", f"{root}/out", f"{root}/checkpoint", valid),
    )
    h = F.col("headers")
    out = t.spark.read.parquet(f"{root}/out")
    return out.select("newsgroup", "article_number", "msg_time", h["x-site"].alias("site"), h["subject"].alias("subject"))


@query("l6_spool_stream", SPOOL_SQL)
def _(t):
    root = shared_path(t.spark, "growing")
    table = EpochTable(t.spark, f"{root}/out", "newsgroup string, article_number bigint, is_multipart boolean, n_parts int, number_header string, lang string, body_md5 string, error string")
    messages = text_messages(t).drop("group")
    width = t.documents.count() // STEPS + 1
    for step in range(STEPS):
        written(write_spool(messages.filter(F.floor((F.col("article_number") - 1) / width) == step), f"{root}/spool"))
        stream = spool_rows(stream_spool(t.spark, f"{root}/spool"))
        run_batches(stream, lambda df, epoch: table.write(df, epoch) and None, f"{root}/checkpoint").awaitTermination()
    return table.all().drop("epoch")


@query("g1_live_merge", f"SELECT *, row_number() OVER (ORDER BY merge_time, feed_index, article_number) AS rank FROM ({MERGED_SQL})")
def _(t):
    root = shared_path(t.spark, "merge")
    merge = StreamMerge(t.spark, root, "newsgroup string, article_number bigint, msg_time timestamp_ntz", MERGED, block_size=BLOCK * 100)
    # feeds arrive at different speeds: the first ones are further on after every step
    early = F.when(F.col("newsgroup") < "transport.demo.p", BLOCK * 10).otherwise(0)
    step = F.least(F.floor(F.greatest(F.col("article_number") - early, F.lit(0)) / (BLOCK * 20)), F.lit(STEPS - 1))
    replay(t, t.late_feed.select(*PLAIN), step, lambda s: run_batches(s, merge.apply, f"{root}/checkpoint"))
    return merge.merged.all().drop("epoch").unionByName(merge.rest(STEPS - 1))


@query("j2_stream_changes", J2_SQL)
def _(t):
    root = shared_path(t.spark, "headers")

    def digests(checks):
        return checks.withColumn("digest", header_digest(F.col("headers")))

    changes = StreamChanges(t.spark, root, "page bigint, check_no bigint, digest string", digests, block_size=BLOCK)
    checks = header_checks(t)
    width = t.events.count() // STEPS + 1
    step = F.floor(F.col("check_no") / width)
    replay(t, checks, step, lambda s: run_batches(s, changes.apply, f"{root}/checkpoint"))
    return changes.changes.all().drop("epoch")


@query("j3_stream_changes", J3_TREE_SQL)
def _(t):
    root = shared_path(t.spark, "contents")
    schema = "page string, check_no bigint, digest string, n_urls bigint"
    changes = StreamChanges(t.spark, root, schema, lambda docs: content_digests(page_contents(docs)), block_size=BLOCK)
    width = t.documents.count() // STEPS + 1
    step = F.floor(F.col("doc_id") / width)
    replay(t, t.documents, step, lambda s: run_batches(s, changes.apply, f"{root}/checkpoint"))
    return changes.changes.all().drop("epoch")


def pyramid(t):
    """The samples, arriving by time, in steps of four widths."""
    root = shared_path(t.spark, "pyramid")
    steps = SeriesPyramid(t.spark, root, ["1h", "2h", "4h", "12h"], "6h", block_size=BLOCK, every=2)
    replay(t, t.samples, thirds("ts"), lambda s: run_batches(s, steps.apply, f"{root}/checkpoint"))
    return steps


@query("i7_pyramid", I7_SQL)
def _(t):
    return rounded(pyramid(t).periods(STEPS - 1, PERIODS, END))


@query("i4_pyramid", f"SELECT *, 'MAX' AS function FROM ({I4_MAX_SQL}) UNION ALL SELECT *, 'LAST' AS function FROM ({I4_LAST_SQL})")
def _(t):
    steps = pyramid(t)
    out = [steps.series(STEPS - 1, "4h", f).withColumn("function", F.lit(f)) for f in ("MAX", "LAST")]
    return rounded(out[0].unionByName(out[1]))


DELAY = "6h"
# one message in fifty comes a step after its time
_COMES = "least(CAST(floor((extract(DAY FROM msg_time) - 1) / 10) AS BIGINT) + CASE WHEN event_id % 50 = 7 THEN 1 ELSE 0 END, 2)"
_JUDGED = f"""come AS (SELECT newsgroup, article_number, msg_time, n_bytes, {_COMES} AS step FROM feed),
newest AS (SELECT s.step, (SELECT max(epoch_us(msg_time)) FROM come c WHERE c.step < s.step) AS us FROM (SELECT DISTINCT step FROM come) s),
judged AS (SELECT c.*, coalesce(epoch_us(msg_time) >= us - 21600000000, true) AS timely FROM come c JOIN newest USING (step)),
mark AS (SELECT (max(epoch_us(msg_time)) // 1000 - 21600001) * 1000 AS us FROM judged WHERE timely)"""


def punctual(t, query=None):
    """The feed, some of it late, against the watermark; ``query`` makes windows of what is in time."""
    root = shared_path(t.spark, "times")
    rows = t.feed.select("newsgroup", "article_number", "msg_time", "n_bytes", "event_id")
    came = OnTime(t.spark, root, "newsgroup string, article_number bigint, msg_time timestamp_ntz, n_bytes bigint", DELAY)

    class Both:
        """Both streams one after the other, for ``replay``."""

        def __init__(self, stream):
            self.first = run_batches(stream, came.apply, f"{root}/checkpoint")

        def awaitTermination(self):
            self.first.awaitTermination()
            if query:
                append_final(came.stream(), query, f"{root}/out", f"{root}/windows").awaitTermination()

    replay(t, rows, F.expr(_COMES.replace("extract(DAY FROM msg_time)", "dayofmonth(msg_time)")), Both)
    return came, root


@query("l_late_rows", f"WITH {_JUDGED} SELECT newsgroup, article_number, msg_time, n_bytes, timely FROM judged")
def _(t):
    came, _ = punctual(t)
    timely = came.on_time.all().withColumn("timely", F.lit(True))
    return timely.unionByName(came.late.all().withColumn("timely", F.lit(False))).drop("epoch")


@query(
    "f8_stream_counts",
    f"""WITH {_JUDGED},
        counted AS (SELECT newsgroup, CAST(floor((epoch_us(msg_time) - 21600000000) / 86400000000) AS BIGINT) * 86400000000 + 21600000000 AS us,
                           count(*) AS n_msgs, CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM judged WHERE timely GROUP BY 1, 2)
        SELECT newsgroup, make_timestamp(c.us) AS start_time, make_timestamp(c.us + 86400000000) AS end_time, n_msgs, n_bytes
        FROM counted c, mark WHERE c.us + 86400000000 <= mark.us""",
)
def _(t):
    _, root = punctual(t, lambda rows: period_counts(rows, "1 day", "6h", DELAY))
    return t.spark.read.parquet(f"{root}/out")


@query(
    "f5_stream_sessions",
    f"""WITH {_JUDGED},
        opened AS (SELECT *, CASE WHEN msg_time - lag(msg_time) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS opens FROM judged WHERE timely
                   WINDOW w AS (PARTITION BY newsgroup ORDER BY msg_time)),
        numbered AS (SELECT *, sum(opens) OVER (PARTITION BY newsgroup ORDER BY msg_time, article_number ROWS UNBOUNDED PRECEDING) AS n FROM opened),
        counted AS (SELECT newsgroup, min(msg_time) AS start_time, max(msg_time) AS last_time, count(*) AS n_msgs,
                           CAST(sum(n_bytes) AS BIGINT) AS n_bytes FROM numbered GROUP BY newsgroup, n)
        SELECT c.* FROM counted c, mark WHERE epoch_us(last_time) + 3599999999 <= mark.us""",
)
def _(t):
    _, root = punctual(t, lambda rows: sessions(rows, "1h", DELAY))
    return t.spark.read.parquet(f"{root}/out")
