"""Status snapshots: INI text in a message body to (section, key, value).

A body is parsed once, in Arrow batches: as nested expressions the same rules cost
several comparisons of every option with every other one, outside generated code.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_SECTION = "DEFAULT"
_ENTRY = pa.struct([("section", pa.string()), ("key", pa.string()), ("value", pa.string())])
_HEADER = re.compile(r"\[(.+)\]")
_HALVES = re.compile(r"\s*[=:]\s*")


def parse_snapshot(body: str) -> dict[str, dict[str, str]]:
    """Options by section: those of the DEFAULT section show in every section that does not
    set them, and the last of repeated options wins.

    A line indented deeper than the option above it goes on with its value, also after blank
    lines, which belong to the value unless they end it, and after comment lines, which do
    not. Other lines without a name are ignored, and so is what stands before all sections."""
    found: dict[str, dict[str, list[str]]] = {}
    options: dict[str, list[str]] | None = None
    value: list[str] | None = None
    indent = 0
    for line in body.split("\n"):
        text = line.strip()
        if not text:
            if value is not None:
                value.append("")
            continue
        if text[0] in "#;":
            continue
        if value is not None and line[0] in " \t" and len(line) - len(line.lstrip()) > indent:
            value.append(text)
            continue
        indent, value = len(line) - len(line.lstrip()), None
        if header := _HEADER.match(text):
            options = found.setdefault(header[1], {})
        elif options is not None and text[0] != "[":
            name, *rest = _HALVES.split(text, maxsplit=1)
            if rest and name:
                options[name.lower()] = value = rest
    plain = {section: {name: "\n".join(parts).rstrip() for name, parts in own.items()} for section, own in found.items()}
    defaults = plain.get(DEFAULT_SECTION, {})
    return {section: defaults | own for section, own in plain.items()}


def _parse_all(bodies: pa.Array) -> pa.Array:
    offsets, sections, keys, values = [0], [], [], []
    for body in bodies.to_pylist():
        if body is None:
            offsets[-1:] = [None, len(keys)]
            continue
        for section, options in parse_snapshot(body).items():
            sections += [section] * len(options)
            keys += options.keys()
            values += options.values()
        offsets.append(len(keys))
    entries = pa.StructArray.from_arrays([pa.array(c, pa.string()) for c in (sections, keys, values)], fields=list(_ENTRY))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), entries)


@lru_cache(maxsize=1)
def _parser():
    return F.arrow_udf(_parse_all, "array<struct<section:string,key:string,value:string>>")


def snapshot_entries(body: Column) -> Column:
    """All (section, key, value) of a snapshot, in the row; null for a null body."""
    return _parser()(body)


def read_snapshots(messages: DataFrame) -> DataFrame:
    """One row per option: ``newsgroup, article_number, msg_time, section, key, value``."""
    # The outer form: for the plain one Spark adds a filter that parses the body once more.
    rows = messages.select(
        "newsgroup", "article_number", "msg_time", F.inline_outer(snapshot_entries(F.col("body")))
    )
    return rows.filter(F.col("key").isNotNull())


def snapshot_value(entries: Column, section: Column, key: Column) -> Column:
    """One option of a parsed snapshot, null when it is missing."""
    hits = F.filter(entries, lambda e: (e["section"] == section) & (e["key"] == key))
    return F.get(hits, F.lit(0))["value"]
