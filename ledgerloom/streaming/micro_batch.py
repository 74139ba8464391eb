"""Ledger entries that arrive as streams: exact matches as soon as both sides are there, and whole reconciliations batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.functions.scoring import normalize_ref
from ledgerloom.plans.engine import MatchResult, reconcile


def exact_stream(a: DataFrame, b: DataFrame, wait: str = "1 hour", apart: str = "1 hour") -> DataFrame:
    """Candidates of equal book, date, cents and reference from two streams with an event time `arrived`, at most `apart` from each other.

    State is dropped once the watermark has passed, so it is bounded by what arrives within `wait` and `apart`.
    """
    key = lambda p: [F.col("book").alias(f"{p}_book"), F.col("date").alias(f"{p}_date"), F.floor(F.col("amount_abs") * 100 + 0.5).alias(f"{p}_cents"), normalize_ref(F.coalesce("ref_number", F.lit(""))).alias(f"{p}_ref"), F.col("id").alias(f"{p}_id"), F.col("arrived").alias(f"{p}_arrived")]
    left, right = a.withWatermark("arrived", wait).select(*key("a")), b.withWatermark("arrived", wait).select(*key("b"))
    same = F.expr(
        f"a_book = b_book AND a_date = b_date AND a_cents = b_cents AND a_ref = b_ref AND b_arrived BETWEEN a_arrived - INTERVAL {apart} AND a_arrived + INTERVAL {apart}"
    )
    return left.join(right, same).select(F.col("a_book").alias("book"), "a_id", "b_id", "a_arrived", "b_arrived")


def reconcile_batches(entries: DataFrame, sink: Callable[[MatchResult, int], None], config: MatchConfig | None = None, checkpoint: str | None = None):
    """A query that reconciles the books of each micro-batch of a stream of entries with `party` A or B, and hands the result to sink."""

    def batch(df: DataFrame, number: int) -> None:
        held = df.persist()
        try:
            sink(reconcile(held.where("party = 'A'"), held.where("party = 'B'"), config), number)
        finally:
            held.unpersist()

    writer = entries.writeStream.foreachBatch(batch).trigger(availableNow=True)
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
