"""Archive names, renames and commands."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions.globs import glob
from tidewire.functions.template import render
from tidewire.functions.times import strftime
from tidewire.operators.select import first_match_rule

# The rule that applies when none is configured.
DEFAULT_RULES = [("*", "*", "<filename>")]


@dataclass(frozen=True)
class NameOptions:
    path: str = ""
    name: str = "<rule>"
    rules: Sequence[tuple[str, str, str]] = field(default_factory=lambda: DEFAULT_RULES)
    procgroup: str = ""
    client: str = ""
    max_messages: int = 1


def _rule_choice(rules: Sequence[tuple[str, str, str]], text_of) -> Column:
    """The expression of the first rule that matches, else the one of the empty template."""
    chain = None
    for feed, name, template in rules:
        hit = glob(F.col("newsgroup"), feed) & glob(F.col("filename"), name)
        text = text_of(template)
        chain = F.when(hit, text) if chain is None else chain.when(hit, text)
    return text_of("") if chain is None else chain.otherwise(text_of(""))


def archive_name(files: DataFrame, options: NameOptions, file_time: Column | None = None) -> Column:
    """Destination of each file (``newsgroup, filename, msg_time``, for batches ``start_time``;
    ``headers`` where the template asks for them).

    The %-codes of the template take the file's own time if given, else the
    message time (one message per file) or the batch start. Only the template
    is expanded, not what comes from file names or headers."""
    if file_time is None:
        file_time = F.col("msg_time" if options.max_messages == 1 else "start_time")
    values: dict = {
        "newsgroup": (F.col("newsgroup"), "."),
        "filename": (F.col("filename"), "."),
        "procgroup": (F.lit(options.procgroup), "/"),
        "clientname": (F.lit(options.client), "/"),
    }
    if "headers" in files.columns:
        values["header"] = F.col("headers")
    base = f"{options.path.rstrip('/')}/{options.name}" if options.path else options.name

    def text_of(template: str) -> Column:
        return _dated(base.replace("<rule>", template), values, file_time)

    return _rule_choice(options.rules, text_of)


def _dated(template: str, values: Mapping, when: Column) -> Column:
    """Expand placeholders and %-codes of a template, each literal piece by itself."""
    pieces, rest = [], template
    while rest:
        start = rest.find("<")
        end = rest.find(">", start)
        if start < 0 or end < 0:
            pieces.append(strftime(when, rest) if "%" in rest else F.lit(rest))
            break
        if start:
            literal = rest[:start]
            pieces.append(strftime(when, literal) if "%" in literal else F.lit(literal))
        pieces.append(render(rest[start : end + 1], values))
        rest = rest[end + 1 :]
    return F.concat(*pieces) if pieces else F.lit("")


def with_history(name: Column, index: Column) -> Column:
    """Fill ``<history>`` with a batch's history index."""
    return F.replace(name, F.lit("<history>"), index.cast("string"))


def rename(files: DataFrame, rules: Sequence[tuple[str, str]], now: Column) -> DataFrame:
    """Name of each file of a page (``page_id, link_no, url``): base name of the url's path,
    ``unknown.N`` where it has none (N counts those of the page), then the first rule whose
    glob matches gives a %-format of the time."""
    path = F.coalesce(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1), F.lit(""))
    base = F.element_at(F.split(path, "/"), -1)
    nameless = base == ""
    w = Window.partitionBy("page_id").orderBy("link_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = files.withColumn("__base", base).withColumn("__n", F.count_if(nameless).over(w) - 1)
    name = F.when(F.col("__base") == "", F.concat(F.lit("unknown."), F.col("__n").cast("string"))).otherwise(F.col("__base"))
    counted = counted.withColumn("__base", name)
    chain = None
    for pattern, fmt in rules:
        hit = glob(F.col("__base"), pattern)
        chain = F.when(hit, strftime(now, fmt)) if chain is None else chain.when(hit, strftime(now, fmt))
    final = F.col("__base") if chain is None else chain.otherwise(F.col("__base"))
    return counted.withColumn("filename", final).drop("__base", "__n")


def joined_path(*steps: Column) -> Column:
    """Steps of a path, one below the other: an absolute step replaces what is above it, empty
    steps, doubled slashes and single dots go, and nothing at all is a dot."""
    path = F.lit("")
    for step in steps:
        below = F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))
        path = F.when(step == "", path).when(step.startswith("/") | (path == ""), step).otherwise(F.concat(below, step))
    names = F.array_join(F.filter(F.split(path, "/"), lambda n: (n != "") & (n != ".")), "/")
    lead = F.when(path.rlike("^//(?!/)"), F.lit("//")).when(path.startswith("/"), F.lit("/")).otherwise(F.lit(""))
    whole = F.concat(lead, names)
    return F.when(whole == "", F.lit(".")).otherwise(whole)


def parse_commands(messages: DataFrame, prefix: str = "", postfix: str = "") -> DataFrame:
    """Lines ``cmd=name`` of a body: command, target path and kind; other lines are ignored.

    Where messages have ``parts``, those of a message are read instead of its body, and
    ``part_no`` says which one a line is from (0 for a body)."""
    place = ["newsgroup", "article_number"]
    if "parts" in messages.columns:
        body = F.array(F.struct(F.lit(0).alias("part_no"), F.col("body").alias("text")))
        texts = F.transform("parts", lambda p: F.struct(p["part_no"].alias("part_no"), p["content"].cast("string").alias("text")))
        messages = messages.select(*place, F.inline(F.when(F.size("parts") > 0, texts).otherwise(body)))
        messages = messages.withColumnRenamed("text", "body")
        place.append("part_no")
    lines = messages.select(*place, F.posexplode(F.split("body", "\n")).alias("line_no", "line"))
    halves = F.split("line", "=")
    command = F.lower(F.trim(F.get(halves, F.lit(0))))
    name = F.trim(F.get(halves, F.lit(1)))
    return lines.filter(F.size(halves) == 2).select(
        *place,
        F.col("line_no").cast("bigint").alias("line_no"),
        command.alias("command"),
        joined_path(F.lit(prefix), name, F.lit(postfix)).alias("target"),
        F.when(command.isin("start", "stop"), command).otherwise("unknown").alias("kind"),
    )


def number_filenames(files: DataFrame, group_dir: bool = False) -> DataFrame:
    """``stem-<article>.suffixes``; names without a dot become ``name-<article>``."""
    number = F.col("article_number").cast("string")
    named = F.when(
        F.instr("filename", ".") > 0,
        F.concat(F.substring_index("filename", ".", 1), F.lit("-"), number, F.regexp_extract("filename", r"^[^.]*(\..*)$", 1)),
    ).otherwise(F.concat(F.col("filename"), F.lit("-"), number))
    path = F.concat(F.col("newsgroup"), F.lit("/"), named) if group_dir else named
    return files.withColumn("numbered", path)


__all__ = [
    "NameOptions", "archive_name", "first_match_rule", "joined_path", "number_filenames", "parse_commands", "rename", "with_history",
]
