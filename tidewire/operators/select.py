"""Choosing feeds, files, messages and log records."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.globs import glob, glob_all, glob_any, include_exclude
from tidewire.functions.times import duration_micros, micros
from tidewire.plans.joins import newest_of

# Severity of the standard log levels.
LEVELS = {
    "CRITICAL": 50, "FATAL": 50, "ERROR": 40, "WARN": 30, "WARNING": 30,
    "INFO": 20, "DEBUG": 10, "NOTSET": 0,
}


def feed_marks(messages: DataFrame, roster: DataFrame | None = None) -> DataFrame:
    """Low and high article number and their distance per feed; feeds of the roster
    (``newsgroup``) without messages have no marks and count 0."""
    marks = messages.groupBy("newsgroup").agg(
        F.min("article_number").alias("low"), F.max("article_number").alias("high")
    )
    if roster is not None:
        marks = roster.select("newsgroup").distinct().join(marks, "newsgroup", "full_outer")
    return marks.withColumn("n_articles", F.coalesce(F.col("high") - F.col("low") + 1, F.lit(0)))


def list_feeds(
    messages: DataFrame, pattern: str = "*", exclude: Sequence[str] = (), roster: DataFrame | None = None
) -> DataFrame:
    """Marks of the feeds a glob accepts and no exclude glob does; filtered before any message is read."""
    keep = include_exclude(F.col("newsgroup"), [pattern], exclude)
    return feed_marks(messages.filter(keep), None if roster is None else roster.filter(keep))


def resolve_feeds(feeds: DataFrame, specs: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Feed names a list of specs stands for: globs expand against the existing feeds minus
    the excludes, plain names pass through even if there is no such feed."""
    globs = [s for s in specs if "*" in s or "?" in s]
    plain = [s for s in specs if s not in globs]
    found = feeds.select("newsgroup").distinct().filter(include_exclude(F.col("newsgroup"), globs, exclude))
    if not plain:
        return found
    names = feeds.sparkSession.createDataFrame([(p,) for p in plain], "newsgroup string")
    return found.unionByName(names).distinct()


def filter_feeds(df: DataFrame, include: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    return df.filter(include_exclude(F.col("newsgroup"), include, exclude))


def filter_filenames(files: DataFrame, include: Sequence[str] = ("*",), exclude: Sequence[str] = ()) -> DataFrame:
    return files.filter(include_exclude(F.col("filename"), include, exclude))


def filter_mounts(usage: DataFrame, include: Sequence[str] = ("*",), exclude: Sequence[str] = ("/dev*", "/run*", "/sys*")) -> DataFrame:
    """Mounts all include globs accept and no exclude glob does."""
    return usage.filter(glob_all(F.col("mount"), include) & ~glob_any(F.col("mount"), exclude))


def headers_match(headers: Column, *required: Mapping[str, str]) -> Column:
    """Every required header is there and its value matches the glob; later requirement
    maps override earlier ones."""
    wanted: dict[str, str] = {}
    for requirement in required:
        wanted.update({name.lower(): pattern for name, pattern in requirement.items()})
    tests = [F.coalesce(glob(F.element_at(headers, name), pattern), F.lit(False)) for name, pattern in wanted.items()]
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def match_headers(messages: DataFrame, *required: Mapping[str, str]) -> DataFrame:
    return messages.filter(headers_match(F.col("headers"), *required))


def time_range(messages: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Messages from start to stop, both included; a plain comparison, so it reaches the scan."""
    if start is not None:
        messages = messages.filter(F.col("msg_time") >= F.lit(start).cast("timestamp_ntz"))
    if stop is not None:
        messages = messages.filter(F.col("msg_time") <= F.lit(stop).cast("timestamp_ntz"))
    return messages


def recent(messages: DataFrame, offset: str | float, now: str) -> DataFrame:
    """Messages of the last ``offset`` before ``now``. Reading them again moves no mark."""
    back = F.expr(f"INTERVAL {duration_micros(offset)} MICROSECOND")
    return messages.filter(F.col("msg_time") >= F.lit(now).cast("timestamp_ntz") - back)


def recent_to_newest(messages: DataFrame, offset: str | float) -> DataFrame:
    """The same per feed, counted back from the feed's newest message."""
    return newest_of(messages, ["newsgroup"], "msg_time", duration_micros(offset), "<=")


def _above(pattern: str) -> list[str]:
    """The patterns of the levels above a pattern, the nearest first."""
    above = []
    while "/" in (pattern := pattern.strip("/")):
        pattern = pattern.rpartition("/")[0]
        above.append(re.sub("/+", "/", pattern.rstrip("/")))
    return above


def expand_log_patterns(patterns: Iterable[str], recursive: bool = False, parents: bool = False) -> list[str]:
    """The names a viewer shows for its patterns: those that match, on request the levels
    above them, and what lies one level (or any depth) below."""
    named = list(patterns)
    levels = named + [up for p in named for up in _above(p)] if parents else named
    below = "/**" if recursive else "/*"
    return [*levels, *(level + below for level in levels)]


#: One star stands for what is left of a level, two for any depth.
_WILD = {"*": "[^/]+", "**": ".*"}


def _path_regex(pattern: str) -> str:
    """A name pattern read wildcard by wildcard; what lies between them is literal."""
    pieces = re.findall(r"\*\*?|[^*]+", pattern)
    return r"\A" + "".join(_WILD.get(piece) or re.escape(piece) for piece in pieces) + r"\z"


def log_name_matches(name: Column, patterns: Sequence[str]) -> Column:
    """Ordered rules, first match decides; ``!`` excludes; no match drops."""
    chain = None
    for pattern in patterns:
        keep = not pattern.startswith("!")
        hit = name.rlike(_path_regex(pattern if keep else pattern[1:]))
        chain = F.when(hit, keep) if chain is None else chain.when(hit, keep)
    return F.lit(False) if chain is None else chain.otherwise(False)


def log_name_filter(records: DataFrame, patterns: Sequence[str]) -> DataFrame:
    return records.filter(log_name_matches(F.col("name"), patterns))


def level_number(level: Column) -> Column:
    chain = None
    for name, number in LEVELS.items():
        hit = F.upper(level) == name
        chain = F.when(hit, number) if chain is None else chain.when(hit, number)
    return chain


def log_level(records: DataFrame, minimum: str) -> DataFrame:
    """Records at or above a level; unknown level names are dropped."""
    return records.filter(level_number(F.col("levelname")) >= LEVELS[minimum.upper()])


def where_valid(messages: DataFrame, valid: Column | Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User hook before merge, relay or archive: a predicate, or a rewrite of the messages."""
    if isinstance(valid, Column):
        return messages.filter(valid)
    return messages.transform(valid)


def first_match_rule(files: DataFrame, rules: Sequence[tuple[str, str, str]]) -> Column:
    """Template of the first rule whose feed and file globs both match, else empty."""
    chain = None
    for feed, name, template in rules:
        hit = glob(F.col("newsgroup"), feed) & glob(F.col("filename"), name)
        chain = F.when(hit, F.lit(template)) if chain is None else chain.when(hit, F.lit(template))
    return F.lit("") if chain is None else chain.otherwise(F.lit(""))
