"""Posting: building messages, numbering them, storing them as tables or spools."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from email import encoders
from email.mime.base import MIMEBase
from email.mime.multipart import MIMEMultipart
from email.mime.text import MIMEText

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.content import content_type
from tidewire.operators.relay import merge_headers
from tidewire.plans import scan
from tidewire.sinks.raw import open_root, put


#: No line of base64 or of a header begins with dashes, so one boundary does for all articles,
#: and neither writer nor reader has to compile a pattern for each.
_BOUNDARY = "===============7439021586374921065=="


def header_map(headers: Mapping[str, str]) -> Column:
    if not headers:
        return F.create_map().cast("map<string,string>")
    return F.create_map(*[F.lit(x) for name, value in headers.items() for x in (name.lower(), value)])


def one_part(filename: Column, content: Column) -> Column:
    """The attachment list of a message with one file."""
    base = F.element_at(F.split(filename, "/"), -1)
    return F.array(
        F.struct(
            F.lit(1).alias("part_no"), base.alias("filename"), content_type(base).alias("content_type"), content.alias("content")
        )
    )


def post(
    items: DataFrame,
    newsgroups: Sequence[str] | str | Column,
    headers: Mapping[str, str] | None = None,
    date: Column | None = None,
    extra: Column | None = None,
    enabled: bool = True,
) -> DataFrame:
    """Messages from texts (``body``) or files (``parts``): date header, then the poster's
    headers, then those of the call; later ones win. A poster that is off posts nothing."""
    if isinstance(newsgroups, Column):
        group = F.lower(newsgroups)
    else:
        names = [newsgroups] if isinstance(newsgroups, str) else newsgroups
        group = F.lit(",".join(n.strip().lower() for n in names))
    maps = [F.create_map(F.lit("newsgroups"), group), header_map(headers or {})]
    if date is not None:
        maps.insert(0, F.create_map(F.lit("x-transport-date"), F.concat(date.cast("string"), F.lit("+00:00"))))
    if extra is not None:
        maps.append(extra)
    columns = items.columns
    body = F.col("body") if "body" in columns else F.lit(None).cast("string")
    parts = F.col("parts") if "parts" in columns else F.lit(None)
    kept = [c for c in columns if c not in ("body", "parts", "headers", "newsgroup")]
    posted = items.select(
        *kept, group.alias("newsgroup"), merge_headers(*maps).alias("headers"), body.alias("body"), parts.alias("parts")
    )
    return posted if enabled else posted.filter(F.lit(False))


def crosspost(messages: DataFrame) -> DataFrame:
    """One row per group of a comma-separated group list."""
    names = F.transform(F.split("newsgroup", ","), lambda n: F.trim(n))
    return messages.withColumn("newsgroup", F.explode(names))


def number_articles(messages: DataFrame, order: str, marks: DataFrame | None = None, block_size: int = scan.BLOCK) -> DataFrame:
    """Article numbers in the given order, after the highest a feed already has (``newsgroup, high``)."""
    numbered = scan.running(messages, ["newsgroup"], order, {"article_number": scan.running_count()}, block_size)
    if marks is None:
        return numbered
    known = numbered.join(marks.select("newsgroup", F.col("high").alias("__high")), "newsgroup", "left")
    return known.withColumn("article_number", F.col("article_number") + F.coalesce("__high", F.lit(0))).drop("__high")


def mime_bytes(headers: Mapping[str, str], body: str | None, parts) -> bytes:
    """The article text of one message."""
    if parts is None:
        message = MIMEText(body or "", _charset="us-ascii" if (body or "").isascii() else "utf-8")
    else:
        message = MIMEMultipart(boundary=_BOUNDARY)
        for part in parts:
            maintype, subtype = part["content_type"].split("/", 1)
            piece = MIMEBase(maintype, subtype)
            piece.set_payload(bytes(part["content"]))
            encoders.encode_base64(piece)
            if part["filename"]:
                piece.add_header("Content-Disposition", "attachment", filename=part["filename"])
            message.attach(piece)
    for name, value in headers.items():
        message[name] = value
    return message.as_bytes()


def write_spool(messages: DataFrame, root: str) -> DataFrame:
    """One article file per message, in a folder tree of the feed's name. Lazy, like write_files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_root(root)
        for frame in frames:
            paths = []
            for group, number, headers, body, parts in zip(
                frame["newsgroup"], frame["article_number"], frame["headers"], frame["body"], frame["parts"]
            ):
                path = f"{group.replace('.', '/')}/{number}"
                put(fs, f"{base}/{path}", mime_bytes(dict(headers), body, parts))
                paths.append(path)
            yield pd.DataFrame({"newsgroup": frame["newsgroup"], "article_number": frame["article_number"], "path": paths})

    columns = messages.select("newsgroup", "article_number", "headers", "body", "parts")
    return columns.mapInPandas(run, "newsgroup string, article_number bigint, path string")


def dead_letter(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good messages, trouble reports): articles with an ``error`` are skipped, count as read
    and are reported."""
    failed = F.col("error").isNotNull()
    text = F.concat_ws(
        "\n",
        F.lit("Problem with article:"),
        F.concat(F.lit("  message num = "), F.col("article_number").cast("string")),
        F.concat(F.lit("  newsgroup   = "), F.col("newsgroup")),
        F.concat(F.lit("  error       = "), F.col("error")),
    )
    trouble = messages.filter(failed).select("newsgroup", "article_number", "error", text.alias("body"))
    return messages.filter(~failed), trouble
