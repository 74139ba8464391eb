"""Pass 1: entries of equal date, cents and reference, matched in order of occurrence."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.functions import scoring as S
from ledgerloom.operators.ranking import CHUNK, occurrence_rank
from ledgerloom.scratch import materialize

_KEY = ["book", "date", "_cents", "_ref"]


def _keyed(side: DataFrame, config: MatchConfig) -> DataFrame:
    ref = F.lit("") if config.ignore_reference_in_exact else S.normalize_ref(F.coalesce("ref_number", F.lit("")))
    keyed = side.where("date IS NOT NULL").withColumn("_cents", S.round_half_up(F.col("amount_abs") * 100).cast("long")).withColumn("_ref", ref)
    return keyed.select(*_KEY, "row_index", "id", "amount_abs", "ref_number")


def _ranked(side: DataFrame, name: str) -> DataFrame:
    return side.select(*_KEY, "rank", *[F.col(c).alias(f"{name}_{c}") for c in ("id", "amount_abs", "ref_number")])


def exact_pairs(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """(book, a_id, b_id, and amount_abs and ref_number of both): the n-th entry of A with a key goes with the n-th of B.

    That is the outcome of giving each entry of A, in order, the first entry of B still free. Keys whose entries may have references that are there but differ
    (only punctuation, other case where case counts, or all where the key has no reference) are matched by the steps of that loop, from run to run of equal references.
    """
    x, y = materialize(_keyed(a, config), "keyed-a"), materialize(_keyed(b, config), "keyed-b")
    raw = F.coalesce("ref_number", F.lit(""))
    exactly = S.normalize_ref(raw, config.case_sensitive_ref)
    blank, low, high = F.max(((raw != "") & (exactly == "")).cast("int")), F.min(F.when(exactly != "", exactly)), F.max(F.when(exactly != "", exactly))
    odd = (blank > 0) | F.coalesce(low != high, F.lit(False))
    loops = x.select(*_KEY, "ref_number").unionByName(y.select(*_KEY, "ref_number")).groupBy(*_KEY).agg(odd.alias("odd")).where("odd").drop("odd")
    loops = materialize(loops, "odd-keys")
    columns = ["book", "a_id", "b_id", "a_amount_abs", "b_amount_abs", "a_ref_number", "b_ref_number"]
    if loops.isEmpty():
        return _ranked(occurrence_rank(x, _KEY), "a").join(_ranked(occurrence_rank(y, _KEY), "b"), [*_KEY, "rank"]).select(*columns)
    plain = [_ranked(occurrence_rank(side.join(loops, _KEY, "left_anti"), _KEY), name) for side, name in ((x, "a"), (y, "b"))]
    p, q = (materialize(occurrence_rank(side.join(loops, _KEY, "left_semi"), _KEY).withColumn("_exact", exactly), "odd-rows") for side in (x, y))
    steps = materialize(_steps(_runs(p), _runs(q)), "odd-steps")
    starts = steps.select(*_KEY, "a_first", "b_first", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("_from"))
    each = starts.repartition(*_KEY, "_from").withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + CHUNK, F.col("n")) - 1)))
    met = each.select(*_KEY, (F.col("a_first") + F.col("_i")).alias("rank"), (F.col("b_first") + F.col("_i")).alias("_other"))
    looped = met.join(_ranked(p, "a"), [*_KEY, "rank"]).drop("rank").withColumnRenamed("_other", "rank").join(_ranked(q, "b"), [*_KEY, "rank"]).select(*columns)
    return plain[0].join(plain[1], [*_KEY, "rank"]).select(*columns).unionByName(looped)


def _runs(side: DataFrame) -> DataFrame:
    """(key, first rank, n, kind): runs of entries of one kind: without a reference (""), with one that has no letter or digit ("-"), or with this one. A run ends at a chunk's end at the latest."""
    kind = F.when(F.coalesce("ref_number", F.lit("")) == "", "").when(F.col("_exact") == "", "-").otherwise(F.col("_exact"))
    cut = side.select(*_KEY, "rank", kind.alias("kind"), F.floor(F.col("rank") / CHUNK).alias("_cut"))
    along = Window.partitionBy(*_KEY, "_cut").orderBy("rank")
    numbered = cut.withColumn("_new", F.coalesce(F.lag("kind").over(along) != F.col("kind"), F.lit(True)).cast("int")).withColumn("_run", F.sum("_new").over(along))
    return numbered.groupBy(*_KEY, "_cut", "_run").agg(F.min("rank").alias("first"), F.count("*").alias("n"), F.first("kind").alias("kind"))


def _steps(a: DataFrame, b: DataFrame) -> DataFrame:
    """(key, a_first, b_first, n): which ranks of either side meet. An entry of A looks at the first free entry of B alone, so a run of A that does not fit it is passed over whole."""

    def walk(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        free = iter(right.sort_values("first")[["first", "n", "kind"]].itertuples(index=False))
        at, many, kind = next(free, (0, 0, None))
        out = []
        for run in left.sort_values("first").itertuples(index=False):
            first, n = run.first, run.n
            while n and many and ("" in (run.kind, kind) or run.kind == kind != "-"):
                step = min(n, many)
                out.append((run.book, run.date, run._2, run._3, first, at, step))
                first, n, at, many = first + step, n - step, at + step, many - step
                if not many:
                    at, many, kind = next(free, (0, 0, None))
        return pd.DataFrame(out, columns=[*_KEY, "a_first", "b_first", "n"])

    schema = "book long, date date, _cents long, _ref string, a_first long, b_first long, n long"
    return a.groupBy(*_KEY).cogroup(b.groupBy(*_KEY)).applyInPandas(walk, schema)


def exact_groups(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """The match groups of pass 1."""
    ref = S.refs_match(F.col("a_ref_number"), F.col("b_ref_number"), config.case_sensitive_ref)
    base = F.greatest("a_amount_abs", "b_amount_abs")
    return exact_pairs(a, b, config).select(
        "book", "a_id", "b_id", F.lit("exact").alias("match_type"), F.lit(100).alias("confidence"), S.reason_exact(base, ref).alias("match_reason"),
        F.lit(0.0).alias("amount_difference"), F.lit(0).alias("date_difference"), F.lit(0.0).alias("description_similarity"), F.lit(1).alias("pass_number"),
    )
