"""Ranks of occurrences that no single task counts alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.scratch import materialize

#: Rows are ranked in runs of so many row numbers; a key's runs are then added up.
CHUNK = 100_000


def occurrence_rank(df: DataFrame, keys: list[str], order: str = "row_index", chunk: int = CHUNK) -> DataFrame:
    """df with `rank`: from 0 in ascending `order` among the rows of equal keys. A key of any size is ranked in runs of at most `chunk` row numbers."""
    cut = df.withColumn("_chunk", F.floor(F.col(order) / chunk))
    counts = cut.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"))
    along = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*keys, "_chunk").orderBy(order))
    named = before.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), "_before")
    same = F.col("_chunk") == F.col("_c")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    ranked = cut.withColumn("_in", inside).join(named, same)
    return ranked.withColumn("rank", F.col("_before") + F.col("_in") - 1).select(*df.columns, "rank")


def counted_before(rows: DataFrame, keys: list[str], order: list[str], counted: str, label: str) -> DataFrame:
    """rows with `before`: how many of the rows of equal keys that the SQL condition `counted` marks come before each in `order`.

    Rows are dealt by ranges of keys and order, which cuts a key of any size; each piece is counted by itself, and the pieces of a key are added up.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()), label)
    one = F.expr(f"CAST({counted} AS BIGINT)")
    along = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = dealt.groupBy(*keys, "_part").agg(F.sum(one).alias("_n")).withColumn("_start", F.coalesce(F.sum("_n").over(along), F.lit(0))).drop("_n")
    inside = F.sum(one).over(Window.partitionBy(*keys, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    counted_inside = dealt.withColumn("_in", F.coalesce(inside, F.lit(0)))
    return counted_inside.join(pieces, [*keys, "_part"]).withColumn("before", F.col("_start") + F.col("_in")).select(*rows.columns, "before")
