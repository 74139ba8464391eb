"""The five passes in order, and what they add up to."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.functions.amounts import exact_sum
from ledgerloom.operators import exact, fuzzy, residue, split, tolerance
from ledgerloom.schema import AMBIGUOUS, ENTRY_COLUMNS, GROUP
from ledgerloom.scratch import materialize

NAMES = {1: "Exact", 2: "Amount + Date", 3: "Fuzzy Description", 4: "Split Detection", 5: "Residue Classification"}


@dataclass
class MatchResult:
    """Groups, what is ambiguous, and the ledgers they are of. `ambiguous` lists every candidate when it is read, `ambiguous_counts` (book, entry_id, n_candidates) how many each entry has."""

    config: MatchConfig
    groups: DataFrame
    ambiguous: DataFrame
    ledger_a: DataFrame
    ledger_b: DataFrame
    ambiguous_counts: DataFrame

    def register(self, prefix: str = "") -> None:
        """Temporary views of everything, for SQL."""
        for name in ("groups", "ambiguous", "ambiguous_counts", "ledger_a", "ledger_b"):
            getattr(self, name).createOrReplaceTempView(prefix + name)


def _as_groups(found: DataFrame) -> DataFrame:
    """Groups in the common schema; an id says the book, the pass and the first entry."""
    if "a_id" in found.columns:
        found = found.withColumn("entries_a", F.array("a_id")).withColumn("entries_b", F.array("b_id"))
    first = F.coalesce(F.get("entries_a", F.lit(0)), F.get("entries_b", F.lit(0)))
    named = found.withColumn("group_id", F.concat_ws("/", F.col("book").cast("string"), F.col("pass_number").cast("string"), "match_type", first)).withColumn("status", F.lit("open"))
    return named.select(*[F.col(f.name).cast(f.dataType) for f in GROUP.fields])


def edges(groups: DataFrame) -> DataFrame:
    """(book, group_id, side, pos, entry_id): groups in normal form."""
    one = lambda side: groups.select("book", "group_id", F.lit(side).alias("side"), F.posexplode(f"entries_{side.lower()}").alias("pos", "entry_id"))
    return one("A").unionByName(one("B"))


def without(entries: DataFrame, groups: DataFrame, side: str) -> DataFrame:
    """Entries of a side that no group holds."""
    used = groups.select("book", F.explode(f"entries_{side.lower()}").alias("id"))
    return entries.join(used, ["book", "id"], "left_anti")


class Cancelled(Exception):
    """A pass was ended by request."""


def _tasks(spark: SparkSession, known: set[int]) -> tuple[int, int]:
    """(done, all) tasks of the stages seen so far; `known` is kept by the caller, as the tracker forgets old stages slowly but lists only active ones."""
    tracker = spark.sparkContext.statusTracker()
    known.update(tracker.getActiveStageIds())
    told = [i for i in map(tracker.getStageInfo, known) if i]
    return sum(i.numCompletedTasks for i in told), sum(i.numTasks for i in told)


@contextmanager
def watched(spark: SparkSession, label: str, cancelled: Callable[[], bool] | None = None, tasks: Callable[[int, int], None] | None = None, every: float = 0.5) -> Iterator[None]:
    """Spark jobs started within carry a tag of their own. A thread asks `cancelled` and, once it says so, cancels the jobs of that tag, again and again, as a pass is many jobs; the body then ends as Cancelled.

    `tasks` is told (done, all) tasks of stages that ran meanwhile, those of other work in the session included. Jobs of other tags are never cancelled. Errors of the callbacks end the body too.
    """
    if not cancelled and not tasks:
        yield
        return
    context, tag = spark.sparkContext, f"{label}-{uuid.uuid4().hex}"
    over, asked, known, raised = threading.Event(), threading.Event(), set(), []

    def watch() -> None:
        while not over.wait(every):
            try:
                if tasks:
                    tasks(*_tasks(spark, known))
                if asked.is_set() or (cancelled and cancelled()):
                    asked.set()
                    context.cancelJobsWithTag(tag)
            except Exception as error:  # noqa: BLE001  raised again where the pass runs
                raised.append(error)
                asked.set()
                cancel_only()
                return

    def cancel_only() -> None:
        while not over.wait(every):
            context.cancelJobsWithTag(tag)

    watcher = threading.Thread(target=watch, daemon=True, name=tag)
    context.addJobTag(tag)
    watcher.start()
    try:
        yield
    except Exception as error:
        if raised:
            raise raised[0] from error
        if asked.is_set():
            raise Cancelled(label) from error
        raise
    finally:
        over.set()
        watcher.join()
        context.removeJobTag(tag)
    if raised:
        raise raised[0]


def reconcile(
    a: DataFrame, b: DataFrame, config: MatchConfig | None = None, progress: Callable[[int, str], None] | None = None, cancelled: Callable[[], bool] | None = None,
    tasks: Callable[[int, int, int], None] | None = None,
) -> MatchResult:
    """Run the enabled passes; each sees only what the ones before left. Their groups are written, so a later pass never recomputes an earlier one.

    progress is called before each pass. cancelled is asked there and, twice a second, while a pass runs; it ends the run with the groups of the passes that were finished, a pass that was running
    counting as not begun. tasks is told (pass, done, all) twice a second.
    """
    config = config or MatchConfig()
    spark: SparkSession = a.sparkSession
    if config.polarity_mode == "auto_detect":
        config = config.with_(polarity_mode=detect_polarity(a, b))
    left, right = (side.select(*[F.col(c).alias(c) for c in ENTRY_COLUMNS]) for side in (a, b))  # columns of their own, also if both come from one table
    groups: DataFrame = spark.createDataFrame([], GROUP)
    ambiguous: DataFrame = spark.createDataFrame([], AMBIGUOUS)
    counts: DataFrame = spark.createDataFrame([], "book long, entry_id string, n_candidates long")
    for number in sorted(set(config.enabled_passes)):
        if cancelled and cancelled():
            break
        if progress:
            progress(number, NAMES[number])
        told = (lambda done, whole, n=number: tasks(n, done, whole)) if tasks else None
        try:
            with watched(spark, f"pass-{number}", cancelled, told):
                several = None
                if number == 1:
                    found = exact.exact_groups(left, right, config)
                elif number == 2:
                    found, several = tolerance.amount_date_groups(left, right, config)
                elif number == 3:
                    found = fuzzy.fuzzy_groups(left, right, config)
                elif number == 4:
                    found = split.split_groups(left, right, config)
                else:
                    found = residue.residue_groups(left, "A", config).unionByName(residue.residue_groups(right, "B", config))
                made = materialize(_as_groups(found), f"pass-{number}")
                if number < 5:
                    left, right = materialize(without(left, made, "A"), "left"), materialize(without(right, made, "B"), "right")
        except Cancelled:
            break
        if several:
            ambiguous, counts = several.candidates(), several.counts()
        groups = made if number == min(config.enabled_passes) else groups.unionByName(made)
    return MatchResult(config, groups, ambiguous, a, b, counts)


def polarity_by_book(a: DataFrame, b: DataFrame, sample: int = 20) -> DataFrame:
    """(book, same, opposite, polarity): whether entries of about the same size have the same or opposite signs: those of the first rows of a book's A against all of its B.

    Sizes meet in logarithmic buckets, as they do for tolerances, so that no book's entries are compared all with all. A book without such a pair is `absolute`.
    """
    bucket = lambda c: F.floor(F.log(F.abs(c)) / 0.0111)  # noqa: E731  sizes within a hundredth are less than 0.01006 apart
    first = a.withColumn("_n", F.row_number().over(Window.partitionBy("book").orderBy("row_index"))).where(F.col("_n") <= sample)  # each task keeps a book's first rows
    few = first.where("amount_abs >= 0.01").select("book", F.col("amount").alias("x"), F.explode(F.array(*[bucket(F.col("amount")) + i for i in (-1, 0, 1)])).alias("_at"))
    near = b.where("amount <> 0").select("book", F.col("amount").alias("y"), bucket(F.col("amount")).alias("_at")).join(few, ["book", "_at"]).where(F.abs(F.abs("y") - F.abs("x")) < F.abs("x") * 0.01)
    counts = near.groupBy("book").agg(F.count_if(F.signum("x") == F.signum("y")).alias("same"), F.count_if(F.signum("x") != F.signum("y")).alias("opposite"))
    found = a.select("book").distinct().join(counts, "book", "left").na.fill(0, ["same", "opposite"])
    told = F.when(F.col("opposite") > 2 * F.col("same"), "opposite_sign").when(F.col("same") > 2 * F.col("opposite"), "same_sign").otherwise("absolute")
    return found.withColumn("polarity", told)


def detect_polarity(a: DataFrame, b: DataFrame, sample: int = 20) -> str:
    """The polarity that all books have, else `absolute`. The answer concerns reports alone."""
    answers = [r.polarity for r in polarity_by_book(a, b, sample).select("polarity").distinct().limit(2).collect()]
    return answers[0] if len(answers) == 1 else "absolute"


def summary(result: MatchResult) -> DataFrame:
    """One row for each book: counts, amounts, discrepancy, match rate and mean confidence. Splits count as matched, but not in the matched amount."""
    side = lambda df, s: df.groupBy("book").agg(F.count("*").alias(f"total_entries_{s}"), exact_sum(F.col("amount_abs")).alias(f"total_amount_{s}"))
    totals = side(result.ledger_a, "a").join(side(result.ledger_b, "b"), "book", "full_outer").na.fill(0)
    of = lambda *types: F.col("match_type").isin(*types)
    matched = of("exact", "amount_date", "fuzzy")
    amount = lambda df: df.select("book", F.col("id").alias("entry_id"), "amount_abs")
    placed = edges(result.groups).join(result.groups.select("book", "group_id", "match_type"), ["book", "group_id"])
    in_a = placed.where("side = 'A'").join(amount(result.ledger_a), ["book", "entry_id"]).groupBy("book").agg(
        exact_sum(F.when(matched, F.col("amount_abs"))).alias("matched_amount"), exact_sum(F.when(of("unmatched_a"), F.col("amount_abs"))).alias("unmatched_amount_a")
    )
    in_b = placed.where("side = 'B'").join(amount(result.ledger_b), ["book", "entry_id"]).groupBy("book").agg(exact_sum(F.when(of("unmatched_b"), F.col("amount_abs"))).alias("unmatched_amount_b"))
    counts = result.groups.groupBy("book").agg(
        F.count_if(matched | of("split")).alias("matched_count"), *[F.count_if(of(t)).alias(f"{t}_count") for t in ("unmatched_a", "unmatched_b", "split", "duplicate")],
        F.count_if(of("fuzzy")).alias("partial_count"), F.avg(F.when((matched | of("split")) & (F.col("confidence") > 0), F.col("confidence"))).alias("mean"),
    )
    least = F.least("total_entries_a", "total_entries_b")
    return totals.join(counts, "book", "left").join(in_a, "book", "left").join(in_b, "book", "left").na.fill(0).select(
        "book", "total_entries_a", "total_entries_b", "matched_count", "unmatched_a_count", "unmatched_b_count", "partial_count", "split_count", "duplicate_count",
        F.when(least > 0, F.col("matched_count") / least).otherwise(0.0).alias("match_rate"), "total_amount_a", "total_amount_b",
        F.abs(F.col("total_amount_a") - F.col("total_amount_b")).alias("total_discrepancy"), "matched_amount", "unmatched_amount_a", "unmatched_amount_b",
        F.floor(F.col("mean") + 0.5).cast("int").alias("average_confidence"),
    )


def pass_summaries(result: MatchResult) -> DataFrame:
    """(book, pass_number, pass_name, match_count, avg_confidence) of each enabled pass, also of one without matches."""
    spark = result.groups.sparkSession
    passes = spark.createDataFrame([(n, NAMES[n]) for n in sorted(set(result.config.enabled_passes))], "pass_number int, pass_name string")
    books = result.ledger_a.select("book").union(result.ledger_b.select("book")).distinct()
    found = result.groups.groupBy("book", "pass_number").agg(F.count("*").alias("match_count"), F.floor(F.avg("confidence") + 0.5).cast("int").alias("avg_confidence"))
    return books.join(F.broadcast(passes)).join(found, ["book", "pass_number"], "left").na.fill(0, ["match_count", "avg_confidence"]).select("book", "pass_number", "pass_name", "match_count", "avg_confidence")


def type_histogram(groups: DataFrame) -> DataFrame:
    """How many groups each type has."""
    return groups.groupBy("book", "match_type").agg(F.count("*").alias("n_groups"))
