"""Links of web pages."""

from __future__ import annotations

import json
from collections.abc import Sequence
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.globs import include_exclude
from tidewire.functions.sizes import let

_TAG = r"""(?is)<((?:a|img)\s(?:"[^"]*"|'[^']*'|[^>"'])*)>"""
_ATTRIBUTE = r"""(?is)[\s"'/]([^\s"'>/=]+)\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_SKIPPED = [r"(?is)<!--.*?-->", r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>"]
# scheme, authority, path, query, fragment
_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]*);"
# the standard's names, as one literal that Spark folds into a map
_NAMED = json.dumps({name: char for name, char in html5.items() if name.endswith(";")})


def _character(entity: Column) -> Column:
    """The text of one entity; an unknown one stays as it is."""
    number = F.regexp_extract(entity, "^&#([0-9]+);$", 1).try_cast("int")
    code = F.conv(F.regexp_extract(entity, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10).try_cast("int")
    at = F.coalesce(number, code)
    valid = at.between(1, 0x10FFFF) & ~at.between(0xD800, 0xDFFF)
    numeric = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(at), 8, "0")), "UTF-32"))
    named = F.try_element_at(F.from_json(F.lit(_NAMED), "map<string,string>"), F.substring(entity, 2, F.length(entity)))
    return F.coalesce(numeric, named, entity)


def _unescape(text: Column) -> Column:
    """All entities decoded, each once, from left to right."""
    between = F.split(text, _ENTITY, -1)
    found = F.concat(F.transform(F.regexp_extract_all(text, F.lit(_ENTITY), F.lit(0)), _character), F.array(F.lit("")))
    decoded = F.array_join(F.zip_with(between, found, lambda t, c: F.concat(t, c)), "")
    return F.when(text.contains("&"), decoded).otherwise(text)


def _attribute(tag: Column, name: str) -> Column:
    """The value of the tag's last such attribute."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(1)).alias("name"),
        F.regexp_extract_all(tag, F.lit(_ATTRIBUTE), F.lit(2)).alias("value"),
    )
    values = F.transform(F.filter(pairs, lambda p: F.lower(p["name"]) == name), lambda p: p["value"])
    return _unescape(F.regexp_replace(F.try_element_at(values, F.lit(-1)), r"""^["']|["']$""", ""))


def url_part(url: Column, part: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, 5 fragment; empty when absent."""
    return F.regexp_extract(url, _URL, part)


def _without_dots(path: Column) -> Column:
    """A path without its . and .. segments."""
    steps = F.split(path, "/")
    walked = F.aggregate(
        steps,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == ".", acc)
        .when(s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc))
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends = F.try_element_at(steps, F.lit(-1)).isin(".", "..")
    return F.concat(F.array_join(walked, "/"), F.when(ends, "/").otherwise(""))


def resolve_url(base: Column, url: Column) -> Column:
    """Absolute form of a link found on a page."""

    def absolute(u: Column) -> Column:
        scheme, authority, path = url_part(base, 1), url_part(base, 2), url_part(base, 3)
        own_path = url_part(u, 3)
        site = F.concat(scheme, F.lit("://"), authority)
        folder = F.regexp_replace(path, r"[^/]*$", "")
        folder = F.when(folder == "", "/").otherwise(folder)
        tail = F.regexp_extract(u, r"(?s)^[^?#]*(.*)$", 1)
        joined = F.when(own_path.startswith("/"), own_path).otherwise(F.concat(folder, own_path))
        base_query = F.regexp_extract(base, r"(?s)^[^?#]*(\?[^#]*)", 1)
        return (
            F.when(url_part(u, 1) != "", u)
            .when(u.startswith("//"), F.concat(scheme, F.lit(":"), u))
            .when(u == "", base)
            .when(u.startswith("#"), F.concat(site, path, base_query, u))
            .when(u.startswith("?"), F.concat(site, path, u))
            .otherwise(F.concat(site, let(joined, _without_dots), tail))
        )

    return let(url, absolute)


def page_links(
    pages: DataFrame,
    include: Sequence[str] = ("*",),
    exclude: Sequence[str] = (),
    links: bool = True,
    body: bool = True,
    images: bool = True,
) -> DataFrame:
    """Urls to retrieve for each page (``page_id, url, html``): the page itself first (``body``), then
    the images (``images``) and links (``links``) whose path matches an include glob and no exclude glob, made absolute, in
    page order. Everything stays in the row until the links are exploded."""
    text = F.col("html")
    for pattern in _SKIPPED:
        text = F.regexp_replace(text, pattern, "")
    found = pages.select("page_id", "url", F.regexp_extract_all(text, F.lit(_TAG), F.lit(1)).alias("tags"))

    def link(tag: Column) -> Column:
        is_image = F.lower(F.substring(tag, 1, 3)) == "img"
        target = F.when(is_image, _attribute(tag, "src")).otherwise(_attribute(tag, "href"))
        return F.struct(F.when(is_image, "image").otherwise("link").alias("kind"), target.alias("target"))

    wanted = found.select("page_id", "url", F.transform("tags", link).alias("found"))
    wanted = wanted.select("page_id", "url", F.posexplode_outer("found").alias("pos", "l"))
    out = None
    if links or images:
        path = url_part(F.col("target"), 3)
        flat = wanted.select("page_id", "url", "pos", F.col("l")["kind"].alias("kind"), F.col("l")["target"].alias("target"))
        if not (links and images):
            flat = flat.filter(F.col("kind") == ("link" if links else "image"))
        kept = flat.filter(F.col("target").isNotNull()).filter(include_exclude(path, include, exclude))
        out = kept.select(
            "page_id", (F.col("pos") + 1).cast("bigint").alias("link_no"), "kind",
            resolve_url(F.col("url"), F.col("target")).alias("link"),
        )
    if body:
        own = pages.select("page_id", F.lit(0).cast("bigint").alias("link_no"), F.lit("page").alias("kind"), F.col("url").alias("link"))
        out = own if out is None else own.unionByName(out)
    return out
