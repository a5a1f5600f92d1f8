"""Ordered scans over long feeds without putting one feed into one task.

A plain window partitioned by feed sorts a whole feed in a single task; one
feed may hold a third of all rows. Every function here works on two levels
instead. The order column of a feed (article number, sequence number,
microseconds) is cut into blocks of ``block_size``; windows run inside
(feed, block), a one-row-per-block summary is scanned over the blocks of a
feed, and what a block inherits from the blocks before it is joined back.

The rows are shuffled on (keys, block). The summary has at most one row
per block; Spark broadcasts it below its size threshold and sort-merge joins
it on the partitioning the rows already have above it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1 << 16
_B = "__block"


@dataclass(frozen=True)
class Running:
    """One running value: kind is sum, max, min or last; inclusive counts the row itself."""

    kind: str
    value: Column
    inclusive: bool = True


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_count(inclusive: bool = True) -> Running:
    return Running("sum", F.lit(1).cast("bigint"), inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def running_min(value: Column, inclusive: bool = True) -> Running:
    return Running("min", value, inclusive)


def last_known(value: Column, inclusive: bool = True) -> Running:
    """The latest non-null value."""
    return Running("last", value, inclusive)


def previous(*columns: str) -> Running:
    """The previous row's values as a struct (null on the first row of a key)."""
    return Running("last", F.struct(*columns), False)


def _order(order: str | Sequence[str]) -> list[str]:
    return [order] if isinstance(order, str) else list(order)


def _with_block(df: DataFrame, order: list[str], block_size: int) -> DataFrame:
    return df.withColumn(_B, F.floor(F.col(order[0]) / F.lit(block_size)))


def _key_copies(keys: Sequence[str]) -> tuple[list[str], list[Column]]:
    """Copies of the keys that are never null, so that they can be joined by plain equality."""
    names = [f"__k{i}" for i in range(len(keys))]
    return names, [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(n) for k, n in zip(keys, names)]


def _attach(rows: DataFrame, carry: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join the block summaries back. Plain equality keeps the rows' partitioning,
    so the rows are not shuffled again; keys must not be null."""
    return rows.join(carry, [*keys, _B], "left")


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    columns: dict[str, Running],
    block_size: int = BLOCK,
) -> DataFrame:
    """Add running values per key in the given order.

    The first order column must be numeric; further ones break ties."""
    order = _order(order)
    names, copies = _key_copies(keys)
    rows = _with_block(df.select("*", *copies), order, block_size)
    keys, key_block = names, [*names, _B]
    upto = Window.partitionBy(*key_block).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy(*key_block).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks_before = Window.partitionBy(*keys).orderBy(_B).rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    local, summary, carry, final = [], [], [], []
    for name, r in columns.items():
        w = upto if r.inclusive else before
        here, total, inherited = f"__l_{name}", f"__t_{name}", f"__c_{name}"
        if r.kind in ("sum", "max", "min"):
            fn = getattr(F, r.kind)
            local.append(fn(r.value).over(w).alias(here))
            summary.append(fn(r.value).alias(total))
            carry.append(fn(total).over(blocks_before).alias(inherited))
        else:
            local.append(F.last(r.value, ignorenulls=True).over(w).alias(here))
            summary.append(F.max_by(r.value, F.when(r.value.isNotNull(), position)).alias(total))
            carry.append(F.last(total, ignorenulls=True).over(blocks_before).alias(inherited))
        if r.kind == "sum":
            final.append((F.coalesce(here, F.lit(0)) + F.coalesce(inherited, F.lit(0))).alias(name))
        elif r.kind == "max":
            final.append(F.greatest(here, inherited).alias(name))
        elif r.kind == "min":
            final.append(F.least(here, inherited).alias(name))
        else:
            final.append(F.coalesce(here, inherited).alias(name))

    inherited = rows.groupBy(*key_block).agg(*summary).select(*key_block, *carry)
    scanned = _attach(rows.select("*", *local), inherited, keys)
    kept = [c for c in df.columns if c not in columns]
    return scanned.select(*kept, *final)


def islands(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    starts: Callable[[Column, Column], Column],
    block_size: int = BLOCK,
    previous: str = "previous",
    island: str = "island",
    following: str | None = None,
    narrow: bool = False,
) -> DataFrame:
    """Cut each key's rows into runs.

    ``starts(before, row)`` gets the previous row's and the row's own
    ``values`` as structs and says whether the row opens a new run; the first
    row of a key always does. Adds the previous row's values, the run id (the
    order value of its first row) and, on request, the following row's values.

    ``narrow`` says that all columns are small and the caller uses them all; then the rows
    and the block summaries come from one and the same shuffle.
    """
    # With keys that are never null the join below puts no filter on one side only, so that
    # both sides are one and the same shuffle, which Spark runs once.
    names, copies = _key_copies(keys)
    block = F.coalesce(F.floor(F.col(order) / F.lit(block_size)), F.lit(0)).alias(_B)
    rows = df.select("*", *copies, block, F.struct(*values).alias("__v"))
    kept = [c for c in df.columns if not c.startswith("__")]
    first = F.struct("__v", F.struct(*kept).alias("__row")) if narrow else F.struct("__v")
    key_block = [*names, _B]
    w = Window.partitionBy(*key_block).orderBy(order)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = Window.partitionBy(*names).orderBy(_B)
    blocks_before = blocks.rowsBetween(Window.unboundedPreceding, -1)

    lagged = F.lag("__v").over(w)
    rows = rows.withColumn("__p", lagged)
    if following:
        rows = rows.withColumn("__n", F.lead("__v").over(w))
    opens = F.col("__p").isNotNull() & starts(F.col("__p"), F.col("__v"))
    rows = rows.withColumn("__s", F.when(opens, F.col(order)))

    summary = rows.groupBy(*key_block).agg(
        F.min_by(first, order)["__v"].alias("__first"),  # the whole row: same columns on both sides
        F.max_by("__v", order).alias("__last"),
        F.min(order).alias("__first_at"),
        F.max("__s").alias("__inner"),
    )
    summary = summary.select(
        "*",
        F.lag("__last").over(blocks).alias("__before"),
        F.lead("__first").over(blocks).alias("__after"),
    )
    head_opens = F.col("__before").isNull() | starts(F.col("__before"), F.col("__first"))
    summary = summary.withColumn("__head", F.when(F.coalesce(head_opens, F.lit(False)), F.col("__first_at")))
    summary = summary.withColumn("__tail", F.coalesce("__inner", "__head"))
    summary = summary.select(
        *key_block,
        "__before",
        "__after",
        F.coalesce(F.col("__head"), F.last("__tail", ignorenulls=True).over(blocks_before)).alias("__open"),
    )
    joined = _attach(
        rows.withColumn("__run", F.last("__s", ignorenulls=True).over(upto)), summary, names
    )
    kept = [c for c in df.columns if c not in (previous, island, following)]
    out = [
        *kept,
        F.coalesce("__p", "__before").alias(previous),
        F.coalesce("__run", "__open").alias(island),
    ]
    if following:
        out.append(F.coalesce("__n", "__after").alias(following))
    return joined.select(*out)
