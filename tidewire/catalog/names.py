"""Scalar functions, names, commands and rosters on the given tables."""

from pyspark.sql import functions as F

from tidewire.catalog import query
from tidewire.functions import content, globs, sizes, template, times
from tidewire.operators import batches as B
from tidewire.operators import naming as J
from tidewire.operators import roster as E
from tidewire.operators.rules import match_first_rule
from tidewire.operators.select import first_match_rule

BLOCK = 1 << 14
_UNITS = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]


def _size_sql(n, step, units, digits=1):
    limit = step - 0.5 * 10**-digits
    value, cases = f"CAST({n} AS DOUBLE)", []
    for unit in units[:-1]:
        cases.append(f"WHEN {value} < {limit} THEN format('{{:.{digits}f}} {unit}', {value})")
        value = f"({value} / {step}.0)"
    return f"CASE {' '.join(cases)} ELSE format('{{:.{digits}f}} {units[-1]}', {value}) END"


_BYTES = "o_orderkey * o_orderkey * 37 + o_orderkey"
_METRIC = ["B", "kB", "MB", "GB", "TB", "PB"]


@query(
    "k1_size_desc",
    f"SELECT o_orderkey, {_size_sql(_BYTES, 1024, _UNITS)} AS binary_size, {_size_sql(_BYTES, 1000, _METRIC, 2)} AS metric_size FROM orders",
)
def _(t):
    n = F.expr(_BYTES)
    return t.table("orders").select(
        "o_orderkey",
        sizes.size_desc(n).alias("binary_size"),
        sizes.size_desc(n, metric=True, precision=2).alias("metric_size"),
    )


@query(
    "k2_parse_timedelta",
    """SELECT event_id, CAST(CASE event_id % 6 WHEN 0 THEN user_id WHEN 1 THEN user_id * 86400 WHEN 2 THEN (user_id % 60) * 60 + 5
              WHEN 3 THEN 86400 + (user_id % 24) * 3600 + 34 * 60 + 45 WHEN 4 THEN user_id * 5400 END AS DOUBLE) AS seconds FROM events""",
)
def _(t):
    text = F.expr(
        """CASE event_id % 6 WHEN 0 THEN concat(user_id, 's') WHEN 1 THEN concat(user_id, ' days') WHEN 2 THEN concat(user_id % 60, ':05')
           WHEN 3 THEN concat('1 days ', user_id % 24, ':34:45') WHEN 4 THEN concat(user_id * 1.5, ' hours') ELSE concat(user_id, ' days 2') END"""
    )
    return t.events.select("event_id", times.parse_timedelta(text).alias("seconds"))


@query(
    "k3_parse_bytes",
    """SELECT event_id, CAST(CASE event_id % 5 WHEN 0 THEN user_id WHEN 1 THEN user_id * 1024 WHEN 2 THEN user_id * 1048576
              WHEN 3 THEN user_id * 1073741824 END AS BIGINT) AS n_bytes FROM events""",
)
def _(t):
    text = F.expr(
        "CASE event_id % 5 WHEN 0 THEN concat(user_id, ' b') WHEN 1 THEN concat(user_id, 'Kb') WHEN 2 THEN concat(user_id, 'mB') "
        "WHEN 3 THEN concat(user_id, ' Gb') ELSE concat(user_id, 'kjh') END"
    )
    return t.events.select("event_id", sizes.parse_bytes(text).alias("n_bytes"))


@query("k4_strptime", "SELECT event_id, date_trunc('second', ts) AS parsed FROM events")
def _(t):
    text = times.strftime(F.col("ts"), "%Y %j %H:%M:%S")
    return t.events.select("event_id", times.strptime(text, "%Y %j %H:%M:%S").alias("parsed"))


@query(
    "k5_epoch",
    "SELECT event_id, epoch_us(ts) / 1e6 AS secs, (epoch_us(ts) - 1704067200000000) / 1e6 AS since FROM events",
)
def _(t):
    since = F.col("ts") - F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    return t.events.select("event_id", times.epoch(F.col("ts")).alias("secs"), times.seconds(since).alias("since"))


@query(
    "k6_strftime",
    "SELECT event_id, strftime(ts, '%Y%m%d-%H%M%S day %j (%a %d %b %y) 100%% %I%p') AS text FROM events",
)
def _(t):
    return t.events.select("event_id", times.strftime(F.col("ts"), "%Y%m%d-%H%M%S day %j (%a %d %b %y) 100%% %I%p").alias("text"))


@query(
    "k7_template",
    """SELECT newsgroup, article_number,
              concat('a/', array_to_string(string_split(newsgroup, '.')[1:2], '.'), '/', string_split(newsgroup, '.')[-1], '/<other>-',
                     site, '/', array_to_string(list_reverse(string_split(newsgroup, '.')), '.')) AS text FROM feed""",
)
def _(t):
    values = {
        "newsgroup": (F.col("newsgroup"), "."),
        "header": F.create_map(F.lit("x-site"), F.col("site")),
    }
    text = template.render('a/<newsgroup[0:2]>/<newsgroup[-1]>/<other>-<header["x-site"]>/<newsgroup[::-1]>', values)
    return t.feed.select("newsgroup", "article_number", text.alias("text"))


@query(
    "k8_glob",
    """SELECT doc_id, regexp_full_match(filename, 'doc-[0-9]?5.*[.]txt') AS literal, filename LIKE concat('doc-%.', lang, '.t_t') AS by_column
       FROM files""",
)
def _(t):
    filename = F.col("filename")
    pattern = F.concat(F.lit("doc-*."), F.col("lang"), F.lit(".t?t"))
    literal = globs.glob_any(filename, ["doc-[0-9]5*.txt", "doc-5*.txt"])
    return t.files.select("doc_id", literal.alias("literal"), globs.glob_column(filename, pattern).alias("by_column"))


@query("k9_checksum", "SELECT doc_id, md5(text) AS checksum FROM documents")
def _(t):
    return t.documents.select("doc_id", content.checksum(F.col("text")).alias("checksum"))


@query(
    "k10_next_tick",
    """SELECT event_id, make_timestamp((epoch_us(ts) - 60000000) // 600000000 * 600000000 + 660000000) AS synced,
              ts + INTERVAL 10 MINUTE AS plain FROM events""",
)
def _(t):
    ts = F.col("ts")
    return t.events.select(
        "event_id", times.next_tick(ts, "10m", "1m").alias("synced"), times.next_tick(ts, "10m", sync=False).alias("plain")
    )


@query(
    "k11_content_type",
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'text/plain' WHEN 1 THEN 'text/html' WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/jpeg'
              WHEN 4 THEN 'application/zip' ELSE 'application/octet-stream' END AS content_type,
              CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.html' WHEN 2 THEN '.png' WHEN 3 THEN '.jpg' WHEN 4 THEN '.zip' ELSE '.bin' END AS extension
       FROM documents""",
)
def _(t):
    name = F.expr(
        "concat('doc-', doc_id, CASE doc_id % 7 WHEN 0 THEN '.txt' WHEN 1 THEN '.html' WHEN 2 THEN '.PNG' WHEN 3 THEN '.jpg' "
        "WHEN 4 THEN '.zip' WHEN 5 THEN '.txt.gz' ELSE '' END)"
    )
    kind = content.content_type(name)
    return t.documents.select("doc_id", kind.alias("content_type"), content.extension_of(kind).alias("extension"))


@query(
    "k12_split_traceback",
    """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN concat('failed ', props) ELSE props END AS message,
              CASE WHEN event_id % 2 = 0 THEN concat(E'Traceback (most recent call last):\\n  ', event_type) END AS exc_info FROM events""",
)
def _(t):
    text = F.expr(
        r"CASE WHEN event_id % 2 = 0 THEN concat('failed ', props, '  \nTraceback (most recent call last):\n  ', event_type) ELSE props END"
    )
    message, trace = content.split_traceback(text)
    return t.events.select("event_id", message.alias("message"), trace.alias("exc_info"))


# ------------------------------------------------------------------ names

RULES = [
    ("*.src1*", "*.en.*", "english/<newsgroup[-1]>/<filename[0]>.%Y%m%d"),
    ("transport.docs.src?", "*", "single/<filename>"),
    ("*", "*.fr.txt", "%j/<filename[1:]>"),
]
_RULE_SQL = """CASE WHEN newsgroup LIKE '%.src1%' AND filename LIKE '%.en.%' THEN 1 WHEN length(newsgroup) = 19 THEN 2
                    WHEN filename LIKE '%.fr.txt' THEN 3 ELSE 0 END"""


@query(
    "e1_first_match_rule",
    f"""SELECT newsgroup, article_number, ['', 'english/<newsgroup[-1]>/<filename[0]>.%Y%m%d', 'single/<filename>',
                                         '%j/<filename[1:]>'][{_RULE_SQL} + 1] AS rule FROM files""",
)
def _(t):
    return t.files.select("newsgroup", "article_number", first_match_rule(t.files, RULES).alias("rule"))


@query(
    "e1_rules_table",
    """WITH rules AS (SELECT doc_id AS rule_no, concat('*.', source) AS feed, concat('doc-', doc_id, '*') AS name, concat(lang, '/', doc_id) AS template
                      FROM documents WHERE doc_id % 3 = 1),
            first AS (SELECT f.doc_id, min(rule_no) AS rule_no FROM files f JOIN rules r
                      ON ends_with(f.newsgroup, substr(r.feed, 2)) AND starts_with(f.filename, substr(r.name, 1, length(r.name) - 1)) GROUP BY 1)
       SELECT newsgroup, article_number, template FROM files LEFT JOIN first USING (doc_id) LEFT JOIN rules USING (rule_no)""",
)
def _(t):
    rules = t.documents.filter("doc_id % 3 = 1").selectExpr(
        "doc_id AS rule_no", "concat('*.', source) AS feed", "concat('doc-', doc_id, '*') AS name", "concat(lang, '/', doc_id) AS template"
    )
    files = t.files.select("newsgroup", "article_number", "filename")
    return match_first_rule(files, rules).drop("filename")


@query(
    "f11_archive_name",
    f"""WITH parts AS (SELECT *, string_split(newsgroup, '.') AS g, string_split(filename, '.') AS n, {_RULE_SQL} AS r FROM files)
        SELECT newsgroup, article_number, concat('/archive/pg/', lang, '/',
               CASE r WHEN 1 THEN concat('english/', g[-1], '/', n[1], '.', strftime(msg_time, '%Y%m%d'))
                      WHEN 2 THEN concat('single/', filename)
                      WHEN 3 THEN concat(strftime(msg_time, '%j'), '/', array_to_string(n[2:], '.')) ELSE '' END, '.0') AS dest
        FROM parts""",
)
def _(t):
    files = t.files.withColumn("headers", F.create_map(F.lit("lang"), F.col("lang")))
    options = J.NameOptions("/archive", '<procgroup>/<header["lang"]>/<rule>.<history>', RULES, procgroup="pg")
    name = J.with_history(J.archive_name(files, options), F.lit(0))
    return files.select("newsgroup", "article_number", name.alias("dest"))


@query(
    "f11_archive_name_batch",
    """WITH batch AS (SELECT newsgroup, floor(epoch_us(msg_time) / 86400000000) AS day, arg_min(msg_time, article_number) AS start_time FROM feed GROUP BY 1, 2)
       SELECT f.newsgroup, article_number, concat(f.newsgroup, '/', strftime(start_time, '%Y-%m-%d_%H%M'), '/', site, '.dat') AS dest
       FROM feed f JOIN batch b ON f.newsgroup = b.newsgroup AND floor(epoch_us(msg_time) / 86400000000) = day""",
)
def _(t):
    feed = t.feed.selectExpr("newsgroup", "article_number", "msg_time", "n_bytes", "concat(site, '.dat') AS filename")
    batched = B.batch_by_span(feed, "1 day", ordered=True)
    starts = B.batch_table(batched).select("newsgroup", "batch_id", "start_time")
    named = batched.join(starts, ["newsgroup", "batch_id"])
    options = J.NameOptions(rules=[("*", "*", "<newsgroup>/%Y-%m-%d_%H%M/<filename>")], max_messages=0)
    return named.select("newsgroup", "article_number", J.archive_name(named, options).alias("dest"))


@query(
    "j5_parse_commands",
    """SELECT newsgroup, article_number, 0 AS line_no, CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' ELSE 'reload' END AS command,
              concat('Groups/', site, '/main') AS target, CASE event_id % 3 WHEN 0 THEN 'start' WHEN 1 THEN 'stop' ELSE 'unknown' END AS kind FROM feed
       UNION ALL SELECT newsgroup, article_number, 3, 'stop', concat('Groups/', user_id, '/main'), 'stop' FROM feed""",
)
def _(t):
    body = F.expr(
        r"concat(CASE event_id % 3 WHEN 0 THEN 'Start' WHEN 1 THEN ' STOP' ELSE 'reload' END, ' = ', site, '\nnonsense\na=b=c\nstop=', user_id)"
    )
    messages = t.feed.select("newsgroup", "article_number", body.alias("body"))
    return J.parse_commands(messages, "Groups", "main")


@query(
    "j6_number_filenames",
    """SELECT newsgroup, article_number, concat(newsgroup, '/', CASE WHEN doc_id % 3 = 0 THEN concat('doc', doc_id, '-', article_number)
              ELSE concat('doc-', doc_id, '-', article_number, '.', lang, '.txt') END) AS numbered FROM files""",
)
def _(t):
    files = t.files.withColumn("filename", F.expr("CASE WHEN doc_id % 3 = 0 THEN concat('doc', doc_id) ELSE filename END"))
    return J.number_filenames(files, group_dir=True).select("newsgroup", "article_number", "numbered")


# ---------------------------------------------------------------- rosters

# the members are the users of the feeds, those seen have the numbers of the suppliers
_ROSTER, _SEEN = "SELECT DISTINCT user_id AS member FROM events", "SELECT s_suppkey AS member FROM supplier"


def roster(t):
    return t.events.select(F.col("user_id").alias("member")).distinct()


def seen(t):
    return t.table("supplier").select(F.col("s_suppkey").alias("member"))


@query("e2_missing_members", f"{_ROSTER} EXCEPT {_SEEN}")
def _(t):
    return E.missing_members(roster(t), seen(t), ["member"])


@query(
    "e3_roster_diff",
    f"""SELECT coalesce(o.member, n.member) AS member, CASE WHEN n.member IS NULL THEN 'stale' WHEN o.member IS NULL THEN 'new' ELSE 'existing' END AS status
        FROM ({_ROSTER}) o FULL JOIN ({_SEEN}) n ON o.member = n.member""",
)
def _(t):
    return E.roster_diff(roster(t), seen(t), ["member"])


@query(
    "e5_cancel",
    "SELECT newsgroup, article_number, md5(CAST(event_id AS VARCHAR)) AS message_id FROM feed WHERE value <= 90 AND newsgroup <> 'transport.demo.view'",
)
def _(t):
    messages = t.feed.select("newsgroup", "article_number", "value", F.md5(F.col("event_id").cast("string")).alias("message_id"))
    targets = messages.filter("value > 90").select("message_id").unionByName(E.cancel_feed(messages, "transport.demo.view"))
    return E.cancel(messages, targets).drop("value")
