"""Log files: text with multi-line records, or JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions.content import split_traceback
from tidewire.schema import BINARY_FILE, LOG_JSON
from tidewire.sinks.raw import arrow_opens

_STARTS = r"(?m)(?=^\[\d{4}-\d{2}-\d{2})"


def _fields(piece: Column) -> Column:
    """The parts of a text record ``[date time level] name: message``, cut by position: up to
    the closing bracket, and from there up to the first colon. Null if it has not this form."""
    bracket = F.instr(piece, "]")
    stamp = F.split(F.trim(F.substring(piece, 2, bracket - 2)), r"\s+")
    rest = F.ltrim(F.substring(piece, bracket + 1, F.length(piece)))
    colon = F.instr(rest, ":")
    whole = piece.startswith("[") & (bracket > 1) & (F.size(stamp) == 3) & (colon > 1)
    level = F.get(stamp, F.lit(2))
    timed = F.get(stamp, F.lit(1)).contains(".") & (level == F.upper(level)) & (level != F.lower(level))
    return F.when(
        whole & timed,
        F.struct(
            F.concat_ws(" ", F.get(stamp, F.lit(0)), F.get(stamp, F.lit(1))).alias("asctime"),
            level.alias("levelname"),
            F.substring(rest, F.lit(1), colon - 1).alias("name"),
            F.substring(rest, colon + 1, F.length(rest)).alias("text"),
        ),
    )


def _log_time(text: Column) -> Column:
    return F.regexp_replace(F.translate(text, ",", "."), r"\s+", " ").try_cast("timestamp_ntz")


def parse_logs(files: DataFrame) -> DataFrame:
    """Records of whole log files (``path, content``): text records where there is any, else
    JSON lines with a time. A traceback is split from its message."""
    trimmed = F.regexp_replace("content", r"\n+\z", "")
    chunks = F.filter(F.split(trimmed, _STARTS), lambda c: _fields(c).isNotNull())
    read = files.select("path", trimmed.alias("content"), chunks.alias("chunks"))
    is_text = F.size("chunks") > 0
    pieces = F.when(is_text, F.col("chunks")).otherwise(F.split("content", "\n"))
    rows = read.select("path", is_text.alias("is_text"), F.posexplode(pieces).alias("record_no", "piece"))
    # the break before the next record belongs to neither
    rows = rows.select("path", F.col("record_no").cast("bigint").alias("record_no"), "is_text", F.regexp_replace("piece", r"\n\z", "").alias("piece"))
    return record_fields(rows)


def record_fields(rows: DataFrame, *kept: str) -> DataFrame:
    """Records from their pieces (``path, record_no, is_text, piece``); others are dropped."""
    is_text, ids = F.col("is_text"), ["path", "record_no", *kept]
    # each is worked out once, in a step before its fields are taken
    text = F.when(is_text, _fields(F.col("piece"))).alias("text")
    json = F.when(~is_text, F.from_json("piece", LOG_JSON)).alias("json")
    message, trace = split_traceback(F.col("text.text"))
    read = rows.select(*ids, text, json).select(
        *ids,
        F.coalesce("text.asctime", "json.asctime").alias("asctime"),
        F.coalesce("text.levelname", "json.levelname").alias("levelname"),
        F.coalesce("text.name", "json.name").alias("name"),
        F.coalesce(message, "json.message").alias("message"),
        F.coalesce(trace, "json.exc_info").alias("exc_info"),
        F.col("json.stderr").alias("stderr"),
        F.col("json.threadName").alias("threadName"),
    )
    return read.filter(F.col("asctime").isNotNull()).withColumn("asctime", _log_time(F.col("asctime")))


def read_logs(spark: SparkSession, root: str, stream: bool = False, files_per_trigger: int | None = None) -> DataFrame:
    """All log files below a folder. A file is read by one task, in order and a range at a time
    (a record may be many lines); different files go to different tasks. In a store that
    only Spark reads, a file is one cell."""
    from tidewire.sources.log_ranges import read_whole_files

    opened = arrow_opens(spark, root)
    reader = spark.readStream if stream else spark.read
    reader = reader.option("recursiveFileLookup", "true")
    reader = reader.format("binaryFile") if opened else reader.format("text").option("wholetext", "true")
    if stream:
        reader = reader.schema(BINARY_FILE if opened else "value string")
        if files_per_trigger:
            reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    path = F.col("_metadata.file_path").alias("path")
    if not opened:
        return parse_logs(reader.load(root).select(path, F.col("value").alias("content")))
    # the name and length of a file are all that Spark reads of it
    files = reader.load(root).select(F.col("path").alias("place"), path, F.col("length").alias("size"))
    return record_fields(read_whole_files(files))
