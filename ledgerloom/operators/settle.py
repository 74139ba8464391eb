"""Choices among candidate pairs that depend on the order of entries, made in parallel.

Most choices do not depend on others and are made in a few rounds of joins. What is left falls into connected components, which are independent of each other: their pairs are
dealt by component, sorted, and read as a stream, so that a task holds what a component has used and not its pairs. Components beyond MOST pairs go through further rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.components import components
from ledgerloom.scratch import materialize

#: Rounds of joins before components are looked for.
ROUNDS = 4
#: So few pairs are read as one component of their book.
FEW = 200_000
#: Pairs of one component that a task reads as a stream.
MOST = 20_000_000


def settle(pairs: DataFrame, one_round: Callable[[DataFrame], tuple[DataFrame, Callable[[DataFrame], DataFrame]]], order: list[Column], stream: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """All choices among pairs (book, a_id, b_id, ...).

    one_round gives what it decides, and a function of that (written) which gives the pairs that are left. stream makes the choices of pairs that come sorted by `component` and then `order`, and yields rows of `schema`.
    """
    live, done, before = materialize(pairs, "live"), [], None
    many = live.count()
    while many:
        for _ in range(ROUNDS):
            if many <= FEW:
                break  # one stream takes less than a round
            found, rest = one_round(live)
            found = materialize(found, "decided")
            done.append(found)
            live = materialize(rest(found), "live")
            many = live.count()
        if many == 0:
            break
        if many <= FEW:
            parts, large = live.withColumn("component", F.concat(F.lit("book "), F.coalesce(F.col("book").cast("string"), F.lit("")))), None
        else:
            name = lambda side: F.concat_ws("|", F.lit(side), F.coalesce(F.col("book").cast("string"), F.lit("")), f"{side}_id")
            roots = components(live.select(name("a").alias("a"), name("b").alias("b")))
            placed = materialize(live.withColumn("_node", name("a")).join(roots.withColumnRenamed("node", "_node").withColumnRenamed("root", "component"), "_node").drop("_node"), "components")
            large = materialize(placed.groupBy("component").agg(F.count("*").alias("n")).where(F.col("n") > MOST).select("component"), "large-components")
            parts = placed.join(large, "component", "left_anti")
        sorted_ = parts.repartition("component").sortWithinPartitions("component", *order)
        done.append(materialize(sorted_.mapInArrow(stream, schema), "decided"))
        if large is None or large.isEmpty():
            break
        live = materialize(placed.join(large, "component").drop("component"), "live")
        many = live.count()
        if many == before:
            break  # nothing that is left can be decided
        before = many
    if not done:
        return live.sparkSession.createDataFrame([], schema)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out
