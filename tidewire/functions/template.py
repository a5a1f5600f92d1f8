"""Name templates: <name>, <name[i]>, <name[a:b:c]> and <name["key"]>."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

_ENTRY = re.compile(r"<([^<>]*)>")
_ITEM = re.compile(r'^(?P<name>\w+)(?:\[(?:(?P<index>-?\d+)|(?P<slice>-?\d*:-?\d*(?::-?\d*)?)|"(?P<key>[^"]+)")\])?$')


def _bound(value: int | None, default: Column, size: Column, low: int, high: Column) -> Column:
    if value is None:
        return default
    place = F.lit(value) if value >= 0 else size + F.lit(value)
    return F.greatest(F.lit(low), F.least(place, high))


def slice_array(items: Column, start: int | None, stop: int | None, step: int | None = None) -> Column:
    """``items[start:stop:step]`` with the usual meaning of omitted and negative bounds."""
    step = 1 if step is None else step
    if step == 0:
        raise ValueError("slice step cannot be zero")
    size = F.size(items)
    if step > 0:
        first = _bound(start, F.lit(0), size, 0, size)
        end = _bound(stop, size, size, 0, size)
        nonempty, last = first < end, end - F.lit(1)
    else:
        first = _bound(start, size - F.lit(1), size, -1, size - F.lit(1))
        end = _bound(stop, F.lit(-1), size, -1, size - F.lit(1))
        nonempty, last = first > end, end + F.lit(1)
    places = F.when(nonempty, F.sequence(first, last, F.lit(step))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.get(items, i))


def render(template: str, values: Mapping[str, Column | tuple[Column, str | None]]) -> Column:
    """Fill a template.

    A value is a string or map column, or a pair (string column, separator)
    for values that can be indexed and sliced. Placeholders of unknown names,
    and map placeholders without a key, stay as they are.
    """
    out, end = [], 0
    for match in _ENTRY.finditer(template):
        if match.start() > end:
            out.append(F.lit(template[end : match.start()]))
        out.append(_fill(match.group(0), match.group(1), values))
        end = match.end()
    if end < len(template):
        out.append(F.lit(template[end:]))
    return F.concat(*out) if out else F.lit("")


def _fill(text: str, entry: str, values: Mapping) -> Column:
    item = _ITEM.match(entry)
    if not item or item["name"] not in values:
        return F.lit(text)
    value = values[item["name"]]
    column, sep = value if isinstance(value, tuple) else (value, None)
    if item["key"] is not None:
        return F.coalesce(F.element_at(column, item["key"]).cast("string"), F.lit(""))
    if sep is None or (item["index"] is None and item["slice"] is None):
        return F.coalesce(column.cast("string"), F.lit(""))
    items = F.split(column, re.escape(sep))
    if item["index"] is not None:
        index = int(item["index"])
        place = F.lit(index) if index >= 0 else F.size(items) + F.lit(index)
        return F.coalesce(F.get(items, place), F.lit(""))
    bounds = [int(b) if b else None for b in item["slice"].split(":")]
    return F.coalesce(F.array_join(slice_array(items, *bounds), sep), F.lit(""))
