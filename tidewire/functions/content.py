"""Payload helpers: checksums, media types, tracebacks."""

from __future__ import annotations

import mimetypes
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_TYPE = "application/octet-stream"


@lru_cache(maxsize=1)
def _types() -> mimetypes.MimeTypes:
    # The interpreter's own table only, so that results do not depend on the host.
    return mimetypes.MimeTypes(filenames=())


def checksum(content: Column) -> Column:
    """md5 of a payload, in hex."""
    return F.md5(content.cast("binary"))


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(x) for item in sorted(table.items()) for x in item]
    return F.element_at(F.create_map(*pairs), key)


def content_type(filename: Column) -> Column:
    """Media type by extension; unknown and compressed names are octet streams."""
    extension = F.regexp_extract(F.element_at(F.split(filename, "/"), -1), r"^.+(\.[^.]*)$", 1)
    known = {k: v for k, v in _types().types_map[True].items()}
    encoded = list(_types().encodings_map)
    found = F.coalesce(_lookup(known, extension), _lookup(known, F.lower(extension)))
    return F.when(extension.isin(encoded), F.lit(DEFAULT_TYPE)).otherwise(F.coalesce(found, F.lit(DEFAULT_TYPE)))


@lru_cache(maxsize=1)
def _extensions() -> dict[str, str]:
    types = _types()
    names = set(types.types_map[True].values()) | set(types.types_map[False].values())
    return {name: types.guess_extension(name) for name in names if types.guess_extension(name)}


def extension_of(media_type: Column, default: str = ".bin") -> Column:
    """Usual extension of a media type, ``.bin`` when unknown."""
    return F.coalesce(_lookup(_extensions(), F.lower(media_type)), F.lit(default))


def split_traceback(text: Column) -> tuple[Column, Column]:
    """(message, exc_info): the text before the first "Traceback", and the rest."""
    at = F.instr(text, "Traceback")
    message = F.when(at == 0, text).otherwise(F.regexp_replace(F.substring(text, F.lit(1), at - F.lit(1)), r"\s+$", ""))
    trace = F.when(at > 0, F.substring(text, at, F.length(text)))
    return message, trace
