"""Connected components by alternating stars, and joins that no frequent key overloads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.scratch import materialize

#: A key is frequent if it has so many rows, and at least one in SHARE of all; so there are at most SHARE frequent keys, whose totals are broadcast.
FREQUENT, SHARE = 200, 20_000


def join_totals(rows: DataFrame, totals: DataFrame, keys: list[str], many: int) -> DataFrame:
    """rows (`many` of them) joined to totals, which has one row for each key and the key's number of rows, `n`.

    Rows of a frequent key stay where they are and meet its total by broadcast; only the others are shuffled.
    """
    often = F.col("n") > max(FREQUENT, many // SHARE)
    hot = F.broadcast(totals.where(often))
    rest = rows.join(hot.select(*keys), keys, "left_anti")
    extra = [c for c in totals.columns if c not in keys]
    one = lambda x, y: x.alias("r").join(y.alias("t"), reduce(lambda p, q: p & q, [F.col(f"r.{k}") == F.col(f"t.{k}") for k in keys])).select("r.*", *[f"t.{c}" for c in extra])
    return one(rows, hot).unionByName(one(rest, totals.where(~often)))


def _with_least(edges: DataFrame, many: int) -> DataFrame:
    """(a, b, m): edges with the least b of their a. The minimum is reduced before its shuffle, and hubs' edges do not move."""
    return join_totals(edges, edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), ["a"], many).drop("n")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): the least node of its connected component, by alternating large and small stars.

    Only edges are moved: each step sends a node's neighbours to the least of them. Every step is written, so lineage stays short and a lost executor costs one step.
    """
    edges = materialize(edges.select("a", "b").where("a <> b").distinct(), "edges")
    many, before = edges.count(), None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * many).select("a", "b", F.least("a", "m").alias("m")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialize(large, "large-star")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = _with_least(down, many).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").unionByName(least.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), "small-star")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == before:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = now
