"""Helpers for groups of rows: connected components, and joins on keys that may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.runtime import materialize

HOT = 1_000  # a key with more than 1 / HOT of the rows is hot, so there are fewer than HOT


def join_spread(rows: DataFrame, table: DataFrame, key: str, size: str) -> DataFrame:
    """Inner join of rows with a table that has each key once and the number of its rows.

    Hot keys are fewer than HOT, so their entries go to every task and their rows stay where
    they are; all other rows meet their entry by key.
    """
    total = F.lit(rows.count())
    is_hot = F.col(size) * HOT > total
    hot = F.broadcast(table.where(is_hot))
    rest = rows.join(hot.select(key), key, "left_anti")
    return rows.join(hot, key).unionByName(rest.join(table.where(~is_hot), key))


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of edges ``a, b``: the smallest node it can reach.

    Alternating large and small stars: neighbours are sent to the smallest neighbour, until
    every component is a star around its smallest node.  Each step is written, and only
    totals come to the driver.
    """
    edges = materialize(edges.where("a <> b").select("a", "b").distinct(), "edges")
    before = None
    while True:
        after = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if after == before or not after[0]:
            break
        before = after
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _to_smallest(both).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = materialize(large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "large-star")
        small = _to_smallest(down)
        sent = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        own = down.groupBy("a").agg(F.min("b").alias("b"))
        edges = materialize(sent.unionByName(own).distinct(), "small-star")
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _to_smallest(pairs: DataFrame) -> DataFrame:
    """Add ``m``, the smallest of a node ``a`` and its neighbours ``b``."""
    least = pairs.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return pairs.join(least, "a")
