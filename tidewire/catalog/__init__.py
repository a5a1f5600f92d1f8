"""Registered queries, each with the SQL it must agree with where SQL can say it."""

from __future__ import annotations

import importlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidewire.catalog.views import SQL_VIEWS, Tables
from tidewire.session import prepare

FAMILIES = ["batching", "selection", "names", "status", "series", "payloads", "intake", "streams"]


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return self.build(Tables(prepare(spark), sf_dir))


_REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    """Register a query; views the SQL names are put in front of it."""

    def wrap(fn):
        _REGISTRY[name] = Query(name, fn, with_views(sql) if sql else None)
        return fn

    return wrap


def with_views(sql: str) -> str:
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, body in SQL_VIEWS.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(body)
                needed.append(name)

    visit(sql)
    if not needed:
        return sql
    views = ",\n".join(f"{name} AS ({SQL_VIEWS[name]})" for name in needed)
    text = sql.strip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {views},\n{text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {views},\n{text[5:]}"
    return f"WITH {views}\n{text}"


def registry() -> dict[str, Query]:
    for family in FAMILIES:
        importlib.import_module(f"tidewire.catalog.{family}")
    return dict(_REGISTRY)
