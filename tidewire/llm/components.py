"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.plans.storage import stage


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of links (a, b): root is the smallest node reachable.

    Each round reconnects nodes to the smallest neighbour known, first upwards, then
    downwards, which keeps the links few and the rounds logarithmic. Minima are
    partly aggregated before their shuffle, so a node with very many links costs a
    row per task. Each round is a written table; only its count and checksum come
    to the driver."""
    links = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while before != (now := _print(links)):
        before = now
        if now[0] == 0:
            break
        links = stage(_small_star(_large_star(links)), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())


def _print(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("a", "b") % 1_000_003)).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    """Every node's larger neighbours go to its smallest neighbour or itself."""
    both = links.union(links.select("b", "a"))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
    moved = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours go to the smallest of them."""
    low = links.groupBy("a").agg(F.min("b").alias("low"))
    moved = links.join(low, "a").where("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.union(low.select("a", F.col("low").alias("b"))).distinct()
