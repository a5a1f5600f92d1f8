"""Message spools: one file per article below a folder tree of feed names."""

from __future__ import annotations

import email
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.content import extension_of
from tidewire.functions.times import duration_micros
from tidewire.schema import BINARY_FILE, MESSAGES
from tidewire.sinks.raw import arrow_opens

# Headers that tell a message's time, in order of preference.
DATE_HEADERS = ["x-transport-date", "nntp-posting-date", "date"]
BODY_NAME = "body.txt"


def _parse_article(raw: bytes, number: int) -> dict:
    message = email.message_from_bytes(raw)
    headers = {name.lower(): str(value) for name, value in message.items()}
    headers["x-transport-articlenumber"] = str(number)
    out = {"headers": headers, "is_multipart": message.is_multipart(), "body": None, "parts": None, "error": None}
    if message.is_multipart():
        leaves = [p for p in message.walk() if p.get_content_maintype() != "multipart"]
        out["parts"] = [
            {
                "part_no": i,
                "filename": part.get_filename(),
                "content_type": part.get_content_type(),
                "content": part.get_payload(decode=True),
            }
            for i, part in enumerate(leaves, start=1)
        ]
    else:
        charset = message.get_content_charset() or "utf-8"
        out["body"] = (message.get_payload(decode=True) or b"").decode(charset)
    return out


def parse_article(raw: bytes, number: int) -> dict:
    """Headers and contents of an article; of an unreadable one the error only."""
    try:
        return _parse_article(raw, number)
    except (LookupError, ValueError, AttributeError, TypeError) as err:
        return {"headers": {}, "is_multipart": False, "body": None, "parts": None, "error": f"{type(err).__name__}: {err}"}


def _parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["headers", "is_multipart", "body", "parts", "error"]
    for frame in frames:
        rows = [parse_article(raw, number) for raw, number in zip(frame["content"], frame["article_number"])]
        parsed = pd.DataFrame(rows, columns=columns)
        parsed["newsgroup"] = frame["newsgroup"].to_numpy()
        parsed["article_number"] = frame["article_number"].to_numpy()
        parsed["path"] = frame["path"].to_numpy()
        parsed["n_bytes"] = frame["length"].to_numpy()
        yield parsed[[f.name for f in MESSAGES.fields]]


def read_spool(spark: SparkSession, root: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """Article files as messages. Unreadable articles keep an ``error`` instead of contents.

    Read at once, names are listed folder by folder and a task opens a thousand articles; a
    stream, and a store that only Spark reads, go by Spark's own files. Empty files are passed over."""
    from tidewire.sources.spool_stream import unread_spool

    if not stream and arrow_opens(spark, root):
        return unread_spool(spark, root, {}).filter("n_bytes > 0")
    reader = spark.readStream if stream else spark.read
    reader = reader.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "[0-9]*")
    if stream:
        reader = reader.schema(BINARY_FILE)
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    folder = root.rstrip("/").split("/")[-1]
    place = F.regexp_extract("path", rf".*/{folder}/(.+)/([0-9]+)$", 1)
    number = F.regexp_extract("path", r"/([0-9]+)$", 1).try_cast("bigint")
    articles = reader.load(root).select(
        "path", "length", "content", F.translate(place, "/", ".").alias("newsgroup"), number.alias("article_number")
    )
    return articles.filter(F.col("article_number").isNotNull()).mapInPandas(_parse, MESSAGES)


def parse_date(text: Column) -> Column:
    """ISO or mail date; zone-less is UTC; null when neither."""
    cleaned = F.regexp_replace(F.regexp_replace(text, r"^\s*[A-Za-z]{3},\s*", ""), r"\s*\([^)]*\)\s*$", "")
    mail = F.regexp_replace(cleaned, r"\s+(?:GMT|UTC|UT|Z)$", " +0000")
    mail = F.when(mail.rlike(r"[+-]\d{4}$"), mail).otherwise(F.concat(mail, F.lit(" +0000")))
    return F.coalesce(
        F.try_to_timestamp(F.when(text.rlike(r"^\s*\d{4}-\d{2}-\d{2}"), F.trim(text))),
        F.try_to_timestamp(F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} "), mail), F.lit("d MMM yyyy HH:mm:ss Z")),
    ).cast("timestamp_ntz")


def message_time(headers: Column, offset: str | float = 0, now: Column | None = None) -> Column:
    """Time of a message: the first of its date headers that can be read, else the current time."""
    dates = [parse_date(F.element_at(headers, name)) for name in DATE_HEADERS]
    current = F.current_timestamp().cast("timestamp_ntz") if now is None else now
    return F.coalesce(*dates, current) + F.expr(f"INTERVAL {duration_micros(offset)} MICROSECOND")


def message_files(messages: DataFrame, default_name: str = BODY_NAME) -> DataFrame:
    """One row per attached file; a plain body is one file with a default name, unnamed parts
    are named by their number and type; only base names are kept."""
    # MIME line breaks of attachments are part of their bytes; a body is text.
    body = F.array(
        F.struct(
            F.lit(1).alias("part_no"),
            F.lit(default_name).alias("filename"),
            F.lit("text/plain").alias("content_type"),
            F.col("body").cast("binary").alias("content"),
        )
    )
    kept = [c for c in messages.columns if c not in ("body", "parts")]
    parts = messages.select(*kept, F.explode(F.when(F.col("parts").isNull(), body).otherwise(F.col("parts"))).alias("p"))
    unnamed = F.concat(F.format_string("part-%03d", F.col("p")["part_no"]), extension_of(F.col("p")["content_type"]))
    given = F.col("p")["filename"]
    name = F.when(given.isNull() | (given == ""), unnamed).otherwise(given)
    return parts.select(
        *kept,
        F.col("p")["part_no"].alias("part_no"),
        F.try_element_at(F.split(name, "/"), F.lit(-1)).alias("filename"),
        F.col("p")["content"].alias("content"),
        F.octet_length(F.col("p")["content"]).cast("bigint").alias("file_bytes"),
    )


def transport_part(headers: Column) -> Column:
    """``(part_no, n_parts)`` of a split message, with the error where the header is malformed."""
    text = F.element_at(headers, "x-transport-part")
    pattern = r"^\s*(\d+)\s*/\s*(\d+)\s*$"
    return F.struct(
        F.regexp_extract(text, pattern, 1).try_cast("int").alias("part_no"),
        F.regexp_extract(text, pattern, 2).try_cast("int").alias("n_parts"),
        F.when(~text.rlike(pattern), F.concat(F.lit("bad part header: "), text)).alias("error"),
    )


def spool_activity(messages: DataFrame) -> DataFrame:
    """Per article: where it is, its size, transport file name and part, and that as text."""
    filename = F.element_at("headers", "x-transport-filename")
    part = F.element_at("headers", "x-transport-part")
    details = F.concat(
        F.lit("("), F.concat_ws(", ", F.concat(F.col("n_bytes").cast("string"), F.lit(" bytes")), filename, part), F.lit(")")
    )
    return messages.select(
        "newsgroup", "article_number", "path", "n_bytes", filename.alias("filename"), part.alias("part"), details.alias("details")
    )
