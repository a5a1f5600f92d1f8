"""Contents: split and join, compression, archives, relays, changes, page links."""

from pyspark.sql import functions as F

from tidewire.catalog import query
from tidewire.operators import batches as B
from tidewire.operators import naming as J
from tidewire.operators import payloads as P
from tidewire.operators import relay as R
from tidewire.plans.storage import shared_path, stage
from tidewire.sources import pages as W

BLOCK = 1 << 14
CHUNK = 2000


def binary_files(t):
    return t.files.select(
        "newsgroup", "article_number", "filename", F.col("content_text").cast("binary").alias("content")
    )


def split_messages(t):
    """The files as posted in parts; a part's article number follows its file's."""
    parts = P.split_files(binary_files(t), CHUNK)
    return parts.withColumn("article_number", F.col("article_number") * 100000 + F.col("part_no"))


_PARTS = f"""sized AS (SELECT *, hex(encode(content_text)) AS h FROM files),
parts AS (SELECT *, unnest(range(greatest(1, (n_bytes + {CHUNK - 1}) // {CHUNK}))) AS part_no FROM sized)"""


@query(
    "f12_split_files",
    f"""WITH {_PARTS}
        SELECT newsgroup, article_number, CASE WHEN n_bytes > {CHUNK} THEN filename END AS original,
               CASE WHEN n_bytes > {CHUNK} THEN concat('chunk.', lpad(CAST(part_no AS VARCHAR), 3, '0')) ELSE filename END AS filename,
               part_no, greatest(1, (n_bytes + {CHUNK - 1}) // {CHUNK}) AS n_parts, md5(content_text) AS checksum,
               substr(h, CAST(part_no * {2 * CHUNK} + 1 AS INT), {2 * CHUNK}) AS content_hex
        FROM parts""",
)
def _(t):
    return P.split_files(binary_files(t), CHUNK).withColumn("content_hex", F.hex("content")).drop("content")


@query(
    "f13_join_parts",
    f"""SELECT newsgroup, filename, CASE WHEN n_bytes > {CHUNK} THEN 1 END AS assembly, md5(content_text) AS digest, n_bytes,
               greatest(1, (n_bytes + {CHUNK - 1}) // {CHUNK}) AS n_parts, 'ok' AS status FROM files""",
)
def _(t):
    return P.join_parts(split_messages(t), BLOCK * 100000).select(
        "newsgroup", "filename", "assembly", F.md5("content").alias("digest"),
        F.octet_length("content").cast("bigint").alias("n_bytes"), F.col("n_parts").cast("bigint").alias("n_parts"), "status",
    )


@query(
    "f13_join_parts_reposted",
    f"""WITH big AS (SELECT *, (n_bytes + {CHUNK - 1}) // {CHUNK} AS n_parts FROM files WHERE n_bytes > {CHUNK}),
        rounds AS (SELECT newsgroup, concat(n_parts, '.dat') AS filename, n_parts, doc_id, content_text, n_bytes,
                          row_number() OVER (PARTITION BY newsgroup, n_parts ORDER BY doc_id) AS assembly FROM big)
        SELECT newsgroup, filename, assembly, md5(content_text) AS digest, n_bytes, 'ok' AS status FROM rounds
        UNION ALL SELECT newsgroup, filename, NULL, md5(content_text), n_bytes, 'ok' FROM files WHERE n_bytes <= {CHUNK}""",
)
def _(t):
    # All split files of a feed with as many parts come under one name, one after the other.
    parts = split_messages(t).withColumn("original", F.when(F.col("n_parts") > 1, F.concat(F.col("n_parts"), F.lit(".dat"))))
    return P.join_parts(parts, BLOCK * 100000).select(
        "newsgroup", "filename", "assembly", F.md5("content").alias("digest"),
        F.octet_length("content").cast("bigint").alias("n_bytes"), "status",
    )


@query(
    "f14_compress_uncompress",
    "SELECT newsgroup, article_number, filename, md5(content_text) AS digest, n_bytes AS original_bytes, true AS smaller, CAST(NULL AS VARCHAR) AS error FROM files",
)
def _(t):
    packed = P.compress(binary_files(t))
    again = P.uncompress(packed)
    return again.select(
        "newsgroup", "article_number", "filename", F.md5("content").alias("digest"), "original_bytes",
        ((F.col("percent") < 100) | (F.col("original_bytes") <= 600)).alias("smaller"), "error",
    )


_DAY = "floor(epoch_us(msg_time) / 86400000000)"


@query(
    "b3_write_archive",
    f"""WITH batch AS (SELECT newsgroup, {_DAY} AS day, arg_min(msg_time, article_number) AS start_time FROM feed GROUP BY 1, 2),
        named AS (SELECT f.newsgroup, article_number, day, concat('weekday-', strftime(start_time, '%a'), '/', site, '.dat') AS dest, props
                  FROM feed f JOIN batch b ON f.newsgroup = b.newsgroup AND {_DAY.replace('msg_time', 'f.msg_time')} = day),
        last AS (SELECT newsgroup, dest, max(day) AS day FROM named GROUP BY 1, 2),
        kept AS (SELECT n.*, coalesce(sum(octet_length(encode(props))) OVER (PARTITION BY n.newsgroup, n.dest ORDER BY article_number
                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
                 FROM named n JOIN last l ON n.newsgroup = l.newsgroup AND n.dest = l.dest AND n.day = l.day)
        SELECT newsgroup, dest, CAST(before // 100 AS BIGINT) AS chunk_no, count(*) AS n_files,
               md5(string_agg(props, '' ORDER BY article_number)) AS digest FROM kept GROUP BY 1, 2, 3""",
)
def _(t):
    feed = t.feed.selectExpr(
        "newsgroup", "article_number", "msg_time", "n_bytes", "concat(site, '.dat') AS filename", "CAST(props AS BINARY) AS content"
    )
    batched = B.batch_by_span(feed, "1 day", ordered=True)
    starts = B.batch_table(batched).select("newsgroup", "batch_id", "start_time")
    named = batched.join(starts, ["newsgroup", "batch_id"]).withColumn("part_no", F.lit(0))
    options = J.NameOptions(rules=[("*", "*", "weekday-%a/<filename>")], max_messages=0)
    files = named.withColumn("dest", J.archive_name(named, options))
    chunks = P.archive_chunks(P.archive_rows(files, max_messages=0), chunk_bytes=100, block_size=BLOCK)
    return chunks.select("newsgroup", "dest", "chunk_no", "n_files", F.md5("content").alias("digest"))


@query(
    "b3_archive_files",
    """SELECT concat(newsgroup, '/', site, '.dat') AS dest, md5(string_agg(props, '' ORDER BY article_number)) AS digest,
              sum(octet_length(encode(props))) AS n_bytes FROM feed GROUP BY 1""",
)
def _(t):
    files = t.feed.selectExpr(
        "newsgroup", "article_number", "0 AS part_no", "0 AS batch_id", "concat(site, '.dat') AS dest", "CAST(props AS BINARY) AS content"
    )
    root = shared_path(t.spark, "archive")
    stage(P.write_archive(files, root, max_messages=0, chunk_bytes=1000, block_size=BLOCK), "written")
    there = t.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    dest = F.regexp_extract("path", r"([^/]+/[^/]+)$", 1)
    return there.select(dest.alias("dest"), F.md5("content").alias("digest"), F.col("length").alias("n_bytes"))


@query(
    "b3_write_archive_single",
    """SELECT newsgroup, dest, digest FROM (
         SELECT newsgroup, concat(site, '.dat') AS dest, md5(props) AS digest,
                row_number() OVER (PARTITION BY newsgroup, site ORDER BY article_number DESC) AS r FROM feed) WHERE r = 1""",
)
def _(t):
    files = t.feed.selectExpr(
        "newsgroup", "article_number", "0 AS part_no", "concat(site, '.dat') AS dest", "CAST(props AS BINARY) AS content"
    )
    return P.archive_rows(files).select("newsgroup", "dest", F.md5("content").alias("digest"))


@query(
    "b3_write_archive_keep",
    """SELECT newsgroup, dest, digest FROM (
         SELECT newsgroup, concat(site, '.dat') AS dest, md5(props) AS digest,
                row_number() OVER (PARTITION BY newsgroup, site ORDER BY article_number) AS r FROM feed WHERE site <> 'site3') WHERE r = 1""",
)
def _(t):
    files = t.feed.selectExpr(
        "newsgroup", "article_number", "0 AS part_no", "concat(site, '.dat') AS dest", "CAST(props AS BINARY) AS content"
    )
    existing = t.feed.filter("site = 'site3'").selectExpr("concat(site, '.dat') AS dest").distinct()
    return P.archive_rows(files, overwrite=False, existing=existing).select("newsgroup", "dest", F.md5("content").alias("digest"))


# ------------------------------------------------------- relay and changes


def messages(t):
    headers = F.create_map(
        F.lit("newsgroups"), F.col("newsgroup"), F.lit("path"), F.lit("a!b"), F.lit("subject"), F.col("props"),
        F.lit("x-site"), F.col("site"), F.lit("xref"), F.col("article_number").cast("string"),
    )
    body = F.expr(r"concat(props, '\n', site)")
    return t.feed.select("newsgroup", "article_number", "msg_time", headers.alias("headers"), body.alias("body"))


@query(
    "j1_relay",
    """SELECT 'transport.relay' AS newsgroup, article_number, msg_time, site, props AS subject, '2' AS lines,
              'lines,newsgroups,subject,x-site' AS names FROM feed""",
)
def _(t):
    copies = R.relay(messages(t), "transport.relay", count_lines=True)
    h = F.col("headers")
    return copies.select(
        "newsgroup", "article_number", "msg_time", h["x-site"].alias("site"), h["subject"].alias("subject"),
        h["lines"].alias("lines"), F.array_join(F.array_sort(F.map_keys(h)), ",").alias("names"),
    )


J2_SQL = """WITH hashed AS (SELECT user_id % 10 AS page, event_id AS check_no, md5(concat('Length: ', length(props), E'\\nServer: ', event_type)) AS digest FROM events)
       SELECT page, check_no, digest FROM hashed QUALIFY lag(digest) OVER (PARTITION BY page ORDER BY check_no) IS DISTINCT FROM digest"""


def header_checks(t):
    def header(name, value):
        return F.struct(F.lit(name).alias("name"), value.alias("value"))

    headers = F.array(
        header("Date", F.col("ts").cast("string")),
        header("Length", F.length("props").cast("string")),
        header("Server", F.col("event_type")),
    )
    return t.events.select((F.col("user_id") % 10).alias("page"), F.col("event_id").alias("check_no"), headers.alias("headers"))


@query("j2_header_changes", J2_SQL)
def _(t):
    return R.header_changes(header_checks(t), block_size=BLOCK).select("page", "check_no", "digest")


_J3 = """WITH hashed AS (SELECT lang AS page, doc_id AS check_no, {digest} AS digest FROM documents)
       SELECT page, check_no, digest, 2 AS n_urls FROM hashed QUALIFY lag(digest) OVER (PARTITION BY page ORDER BY check_no) IS DISTINCT FROM digest"""
# a tree of one node: its leaves are the language and the text
J3_TREE_SQL = _J3.format(digest="md5(md5(concat('0:', md5(lang), E'\\n1:', md5(text))))")


def page_contents(documents):
    return documents.selectExpr(
        "lang AS page", "doc_id AS check_no",
        "inline(array(struct(1 AS url_no, CAST(text AS BINARY) AS content), struct(0 AS url_no, CAST(lang AS BINARY) AS content)))",
    )


@query("j3_content_changes", _J3.format(digest="md5(concat(lang, text))"))
def _(t):
    return R.content_changes(page_contents(t.documents), block_size=BLOCK)


@query("j3_tree_changes", J3_TREE_SQL)
def _(t):
    return R.tree_changes(page_contents(t.documents), block_size=BLOCK)


_PAGES = """
pages2 AS (SELECT page_id, url, concat('<html><!-- <a href="/no"> -->', html, '<IMG alt="a>b" src=''../pics/p', page_id, '.png''><a class=x href=sub/',
                  page_id, '.html?a=1&amp;b=2#f>t</a><img src="//cdn.example.org/', page_id % 7, '.gif">') AS html FROM pages),
site AS (SELECT *, regexp_extract(url, '^(https?)', 1) AS scheme, regexp_extract(url, '^(https?://[^/?#]*)', 1) AS host,
                regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM pages2),
dirs AS (SELECT *, CASE WHEN path = '' THEN '/' ELSE regexp_replace(path, '[^/]*$', '') END AS folder FROM site),
navs AS (SELECT *, regexp_extract_all(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<a href="([^"]*)"', 1) AS hrefs FROM dirs),
nav AS (SELECT *, unnest(hrefs) AS href, unnest(range(len(hrefs))) AS pos FROM navs),
links AS (
  SELECT page_id, 0 AS link_no, 'page' AS kind, url AS link FROM dirs
  UNION ALL SELECT page_id, pos + 1, 'link', concat(host, href) FROM nav WHERE href NOT LIKE '/a%'
  UNION ALL SELECT page_id, len(hrefs) + 1, 'image', concat(host, CASE WHEN folder = '/' THEN '/' ELSE regexp_replace(folder, '[^/]+/$', '') END, 'pics/p', page_id, '.png') FROM navs
  UNION ALL SELECT page_id, len(hrefs) + 2, 'link', concat(host, folder, 'sub/', page_id, '.html?a=1&b=2#f') FROM navs
  UNION ALL SELECT page_id, len(hrefs) + 3, 'image', concat(scheme, '://cdn.example.org/', page_id % 7, '.gif') FROM navs)"""


def linked_pages(t):
    return t.pages.select(
        "page_id",
        "url",
        F.expr(
            """concat('<html><!-- <a href="/no"> -->', html, '<IMG alt="a>b" src=\\'../pics/p', page_id, '.png\\'><a class=x href=sub/',
               page_id, '.html?a=1&amp;b=2#f>t</a><img src="//cdn.example.org/', page_id % 7, '.gif">')"""
        ).alias("html"),
    )


def page_links(t):
    return W.page_links(linked_pages(t), ["*"], ["/a*"])


@query("a8_page_links", f"WITH {_PAGES} SELECT * FROM links")
def _(t):
    return page_links(t)


@query(
    "j4_rename",
    f"""WITH {_PAGES}, named AS (SELECT page_id, link_no, link AS url, regexp_extract(link, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM links),
        based AS (SELECT *, string_split(p, '/')[-1] AS base FROM named),
        numbered AS (SELECT *, CASE WHEN base = '' THEN concat('unknown.', count(*) FILTER (base = '')
                              OVER (PARTITION BY page_id ORDER BY link_no ROWS UNBOUNDED PRECEDING) - 1) ELSE base END AS name FROM based)
        SELECT page_id, link_no, url, CASE WHEN name LIKE '%.png' THEN '20240131-0015.png' WHEN name LIKE 'unknown.?' THEN 'x' WHEN name LIKE 't%' THEN 't-031' ELSE name END AS filename
        FROM numbered""",
)
def _(t):
    files = page_links(t).select("page_id", "link_no", F.col("link").alias("url"))
    now = F.lit("2024-01-31 00:15:00").cast("timestamp_ntz")
    return J.rename(files, [("*.png", "%Y%m%d-%H%M.png"), ("t*", "t-%j")], now)
