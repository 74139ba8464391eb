"""Tolerance joins as equality joins: amounts and dates are cut into buckets so wide that a match lies in the same or a neighbouring one."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig

#: A bucket is heavy if it has so many entries of A, and at least one in SHARE of all; so there are at most SHARE heavy buckets, whose numbers are broadcast.
HEAVY, SHARE = 2000, 20_000
#: A cell of `near_cells` has at most about so many entries of A and of B.
CELL = 1000, 3000
#: Matching amounts are at most 1.0064 apart on the scale below.
WIDTH = 1.1


def amount_bucket(amount: Column, config: MatchConfig) -> Column:
    """The bucket of an absolute amount: linear where the fixed tolerance is the wider, logarithmic where the percentage is."""
    p, f = config.percent, config.fixed
    if p == 0 and f == 0:
        return F.xxhash64(amount + 0.0)
    if p == 0:
        place = amount / f
    else:
        step = -math.log(1 - p)
        if f == 0:
            place = F.when(amount > 0, F.log(amount) / step)
        else:
            turn = f / p
            place = F.when(amount < turn, amount / f).otherwise(1 / p + F.log(F.greatest(amount, F.lit(turn)) / turn) / step)
    return F.coalesce(F.floor(place / WIDTH), F.lit(-(2**62)))


def neighbours(bucket: Column, config: MatchConfig) -> Column:
    """The buckets that can hold a match of an amount in this one."""
    if config.percent == 0 and config.fixed == 0:
        return F.array(bucket)
    return F.array(bucket - 1, bucket, bucket + 1)


def near_pairs(a: DataFrame, b: DataFrame, config: MatchConfig, dated: bool, condition: Column, around: str = "b") -> DataFrame:
    """Pairs of entries of a book within the amount tolerance and, if `dated`, the date window (a missing date is in any), for which `condition` holds.

    Columns are prefixed a_ and b_. Pairs meet in one bucket each, so none is found twice. Rows without a date meet the others by amount alone. Entries of the side `around` are put into the neighbouring
    buckets, too; where dated, that is better the smaller side.
    """
    named = {"a": a.select(*[F.col(c).alias(f"a_{c}") for c in a.columns]), "b": b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])}
    if not dated:
        around = "b"
    still = "ab".replace(around, "")
    left = named[still].withColumn("_bucket", amount_bucket(F.col(f"{still}_amount_abs"), config))
    right = named[around].withColumn("_near", F.explode(neighbours(amount_bucket(F.col(f"{around}_amount_abs"), config), config)))
    same = (F.col("a_book") == F.col("b_book")) & (F.col("_bucket") == F.col("_near")) & condition
    if not dated:
        return _spread(left, right, same, condition)
    days = config.date_tolerance_days + 1
    day = lambda c: F.floor(F.datediff(F.col(c), F.lit("1970-01-01").cast("date")) / days)
    at = left.where(f"{still}_date IS NOT NULL").withColumn("_day", day(f"{still}_date"))
    near = day(f"{around}_date")
    over = right.where(f"{around}_date IS NOT NULL").withColumn("_days", F.explode(F.array(near - 1, near, near + 1)))
    within = at.join(over, same & (F.col("_day") == F.col("_days"))).drop("_day", "_days")
    undated = left.where(f"{still}_date IS NULL").join(right, same).unionByName(left.where(f"{still}_date IS NOT NULL").join(right.where(f"{around}_date IS NULL"), same))
    return within.unionByName(undated).drop("_bucket", "_near")


def _spread(left: DataFrame, right: DataFrame, same: Column, condition: Column) -> DataFrame:
    """The join on bucket alone, for conditions that are dear: entries of A in a heavy bucket are dealt to several tasks, each of which gets that bucket's entries of B.

    Partitions are asked for by number, as the adaptive planner would put these few bytes together in one task, however long their pairs take.
    """
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sizes = left.groupBy("a_book", "_bucket").agg(F.count("*").alias("_n"))
    most = F.greatest(F.lit(HEAVY), F.lit(left.count() // SHARE))
    heavy = F.broadcast(sizes.where(F.col("_n") > most).select(F.col("a_book").alias("_hot_book"), F.col("_bucket").alias("_hot"), F.ceil(F.col("_n") / most).alias("_cuts")))
    at = lambda side, book, bucket: side.join(heavy, F.col(book).eqNullSafe(F.col("_hot_book")) & (F.col(bucket) == F.col("_hot")), "left").withColumn("_cuts", F.coalesce("_cuts", F.lit(1))).drop("_hot_book", "_hot")
    x = at(left, "a_book", "_bucket").withColumn("_cut", F.pmod(F.xxhash64("a_id"), F.col("_cuts"))).drop("_cuts")
    y = at(right, "b_book", "_near").withColumn("_cut_b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_cuts") - 1))).drop("_cuts")
    x, y = x.repartition(parts, "a_book", "_bucket", "_cut"), y.repartition(parts, "b_book", "_near", "_cut_b")
    return x.join(y, same & (F.col("_cut") == F.col("_cut_b"))).drop("_bucket", "_near", "_cut", "_cut_b")


def near_cells(a: DataFrame, b: DataFrame, config: MatchConfig):
    """Cells of entries of a book in one bucket, cogrouped: every pair within the amount tolerance meets in one cell, with others beyond it. Either side of a heavy bucket is dealt to several cells.

    The function that is applied sees one cell at a time, so neither a bucket nor its pairs are held by one call.
    """
    sides = []
    for side, bucket, limit in ((a, amount_bucket(F.col("amount_abs"), config), CELL[0]), (b, F.explode(neighbours(amount_bucket(F.col("amount_abs"), config), config)), CELL[1])):
        entries = side.where("book IS NOT NULL AND amount_abs IS NOT NULL").withColumn("_bucket", bucket)
        sizes = entries.groupBy("book", "_bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
        sides.append((entries, F.broadcast(sizes.select("book", "_bucket", F.ceil(F.col("_n") / limit).alias("_cuts")))))

    def dealt(own: int, name: str, other: str) -> DataFrame:
        (entries, cuts), (_, others) = sides[own], sides[1 - own]
        cut = entries.join(cuts, ["book", "_bucket"], "left").withColumn(name, F.pmod(F.xxhash64("id"), F.coalesce("_cuts", F.lit(1)))).drop("_cuts")
        return cut.join(others, ["book", "_bucket"], "left").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_cuts", F.lit(1)) - 1))).drop("_cuts")

    keys = ["book", "_bucket", "_cut_a", "_cut_b"]
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    x, y = (side.repartition(parts, *keys) for side in (dealt(0, "_cut_a", "_cut_b"), dealt(1, "_cut_b", "_cut_a")))  # asked for by number, as few bytes may be many pairs
    return x.groupBy(*keys).cogroup(y.groupBy(*keys))
