"""Relaying messages and detecting changes."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.plans import scan

# Headers the receiving server sets itself.
SERVER_HEADERS = [
    "newsgroups", "path", "date", "injection-date", "injection-info", "message-id", "nntp-posting-host",
    "nntp-posting-date", "x-trace", "x-complaints-to", "xref",
]


def merge_headers(*maps: Column) -> Column:
    """One header map; later maps win."""

    def over(earlier: Column, extra: Column) -> Column:
        kept = F.map_filter(earlier, lambda name, _: ~F.array_contains(F.map_keys(extra), name))
        return F.map_concat(kept, extra)

    return reduce(over, maps)


def relay(messages: DataFrame, target: str, count_lines: bool = False) -> DataFrame:
    """Copies for another feed: server headers stripped, the new group set, on request the
    number of body lines."""
    kept = F.map_filter("headers", lambda k, v: ~F.lower(k).isin(SERVER_HEADERS))
    added = [F.lit("newsgroups"), F.lit(target)]
    if count_lines:
        added += [F.lit("lines"), F.size(F.split("body", "\n")).cast("string")]
    return messages.withColumn("headers", merge_headers(kept, F.create_map(*added))).withColumn(
        "newsgroup", F.lit(target)
    )


#: Contents under one node of a check's digest tree.
FAN_OUT = 1024


def header_digest(headers: Column, exclude: Sequence[str] = ("Date",)) -> Column:
    """md5 over the headers (array of ``name, value``) without the excluded ones."""
    kept = F.filter(headers, lambda h: ~h["name"].isin(list(exclude)))
    lines = F.transform(kept, lambda h: F.concat(h["name"], F.lit(": "), h["value"]))
    return F.md5(F.array_join(lines, "\n").cast("binary"))


def content_digests(contents: DataFrame, key: str = "page", order: str = "check_no") -> DataFrame:
    """One ``digest`` for each check (``key, order``) over what was retrieved (``url_no, content``), and ``n_urls``.

    A tree: the md5 of each content is taken in the row it was read in, that of up to 1024 of
    them by ``url_no`` is a node, that of the nodes the digest. So no content is shuffled, and no
    group holds more than a node. Moving bytes from one url to the next is a change, and so is
    null (not retrieved) in place of an empty content."""
    leaf = F.struct("url_no", F.coalesce(F.md5("content"), F.lit("")).alias("md5"))
    leaves = contents.select(key, order, F.floor(F.col("url_no") / F.lit(FAN_OUT)).alias("__node"), leaf.alias("__leaf"))
    line = lambda l: F.concat_ws(":", l["url_no"].cast("string"), l["md5"])
    nodes = leaves.groupBy(key, order, "__node").agg(
        _digest(F.array_sort(F.collect_list("__leaf")), line).alias("__md5"), F.count("*").alias("__n")
    )
    node = F.struct("__node", "__md5")
    return nodes.groupBy(key, order).agg(
        _digest(F.array_sort(F.collect_list(node)), lambda n: n["__md5"]).alias("digest"), F.sum("__n").alias("n_urls")
    )


def _digest(items: Column, line: Callable[[Column], Column]) -> Column:
    return F.md5(F.array_join(F.transform(items, line), "\n").cast("binary"))


def _changes(rows: DataFrame, key: str, order: str, digest: Column, block_size: int) -> DataFrame:
    hashed = rows.withColumn("digest", digest)
    linked = scan.running(hashed, [key], order, {"__before": scan.previous("digest")}, block_size)
    before = F.col("__before")["digest"]
    return linked.filter(~F.col("digest").eqNullSafe(before)).drop("__before")


def header_changes(
    checks: DataFrame, exclude: Sequence[str] = ("Date",), key: str = "page", order: str = "check_no", block_size: int = scan.BLOCK
) -> DataFrame:
    """Checks whose headers (array of ``name, value``), without the excluded ones, differ from the check before."""
    return _changes(checks, key, order, header_digest(F.col("headers"), exclude), block_size)


def content_changes(
    contents: DataFrame, key: str = "page", order: str = "check_no", block_size: int = scan.BLOCK
) -> DataFrame:
    """Checks (``key, order``) whose retrieved contents (``url_no, content``) differ from the check before.

    The digest is that of all contents of a check one after the other, which have to meet in one
    row for it; ``tree_changes`` does without."""
    whole = contents.groupBy(key, order).agg(
        F.md5(F.expr("listagg(content) WITHIN GROUP (ORDER BY url_no)")).alias("__md5"),
        F.count("*").alias("n_urls"),
    )
    return _changes(whole, key, order, F.col("__md5"), block_size).drop("__md5")


def tree_changes(
    contents: DataFrame, key: str = "page", order: str = "check_no", block_size: int = scan.BLOCK
) -> DataFrame:
    """As ``content_changes``, by ``content_digests``: contents stay in the row they were read in."""
    cut = scan.islands(
        content_digests(contents, key, order), [key], order, ["digest"],
        lambda before, row: before["digest"] != row["digest"],
        block_size, previous="__before", island="__run", narrow=True,
    )
    return cut.filter(F.col("__run") == F.col(order)).drop("__before", "__run")
