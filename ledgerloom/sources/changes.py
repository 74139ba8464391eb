"""What people change after a reconciliation: an append-only log of edits, statuses, resolved ambiguities, comments and runs.

A log is a folder of pieces. A piece is a table of changes in a folder of its own, so writers never meet in one folder, and counts once its file `replaces` is there, which is made last and by one
rename. That file names the pieces that this one takes the place of: none for a batch that was appended; for a compacted one, all that it was made of. What is live are the complete pieces that no
complete piece replaces.

The state is the same whatever the order in which pieces are read, however often a change is read, and however compactions overlap: of edits, statuses and resolutions the greatest (at, seq, change_id)
of a key wins, and comments and runs are told apart by their change_id. So two writers lose nothing, and two compactions at once only leave two pieces that hold the same.

Only names of pieces are on the driver: as many as there were appends since the last compact and vacuum.
"""

from __future__ import annotations

import uuid
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.plans import report
from ledgerloom.plans.engine import MatchResult
from ledgerloom.schema import STATUSES

#: A change. `field` is that of an edit, else empty; `seq` orders changes of one instant.
CHANGE = "kind string, key string, field string, value string, author string, at timestamp, seq long, change_id string"
#: Fields of an entry that can be edited, with their types.
EDITABLE = {"date": "date", "description": "string", "debit": "double", "credit": "double", "balance": "double", "ref_number": "string"}
#: Kinds of which the last change of a key counts; of the others every one counts.
LAST_WINS = ["edit", "status", "resolved"]
_ORDER = ["at", "seq", "change_id"]


class ChangeLog:
    """The log in a folder that all writers and readers share."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm, self._conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self._files = self._place("").getFileSystem(self._conf)

    def _place(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    # pieces

    def _complete(self) -> dict[str, set[str]]:
        """Each complete piece with those that it replaces."""
        if not self._files.exists(self._place("")):
            return {}
        found = {}
        for folder in self._files.listStatus(self._place("")):
            name = folder.getPath().getName()
            mark = self._place(f"{name}/replaces")
            if self._files.exists(mark):
                source = self._files.open(mark)
                try:
                    found[name] = set(self._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").split())
                finally:
                    source.close()
        return found

    def live(self) -> list[str]:
        """The pieces that make up the state."""
        pieces = self._complete()
        gone = set().union(*pieces.values())
        return sorted(set(pieces) - gone)

    def _write(self, changes: DataFrame, replaces: list[str], name: str) -> str:
        changes.write.parquet(f"{self.path}/{name}/rows")
        out = self._files.create(self._place(f"{name}/replaces.part"), True)
        try:
            out.write(bytearray("\n".join(replaces).encode()))
        finally:
            out.close()
        if not self._files.rename(self._place(f"{name}/replaces.part"), self._place(f"{name}/replaces")):
            raise OSError(f"the piece {name} could not be completed")
        return name

    def _append(self, changes: DataFrame, kind: str, key: Column, field: Column, value: Column) -> str:
        """One piece of changes. Missing columns: `author` is empty, `at` is now, `seq` is 0. Keys, times and values are whole: a null key raises, a null time is now, a null seq is 0."""
        name = f"batch-{uuid.uuid4().hex}"
        given = lambda c, other: F.coalesce(F.col(c), other) if c in changes.columns else other
        whole = F.when(key.isNull(), F.raise_error(F.lit("a change has no key"))).otherwise(key.cast("string"))
        rows = changes.select(
            F.lit(kind).alias("kind"), whole.alias("key"), field.alias("field"), value.cast("string").alias("value"), given("author", F.lit("")).alias("author"),
            given("at", F.current_timestamp()).cast("timestamp").alias("at"), given("seq", F.lit(0)).cast("long").alias("seq"), F.format_string("%s-%016d", F.lit(name), F.monotonically_increasing_id()).alias("change_id"),
        )
        return self._write(rows, [], name)

    # what can be appended

    def edit(self, edits: DataFrame) -> str:
        """Values of entries set by hand: (id, any of EDITABLE). A null leaves its field as it is; each field is a change of its own, so edits of different fields of one entry add up."""
        fields = [c for c in EDITABLE if c in edits.columns]
        if not fields:
            raise ValueError(f"an edit sets one of {list(EDITABLE)}")
        one = F.filter(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast(EDITABLE[c]).cast("string").alias("text")) for c in fields]), lambda x: x["text"].isNotNull())
        kept = [c for c in ("id", "author", "at", "seq") if c in edits.columns]
        spread = edits.select(*kept, F.explode(one).alias("_set"))
        return self._append(spread, "edit", F.col("id"), F.col("_set.name"), F.col("_set.text"))

    def set_status(self, changes: DataFrame) -> str:
        """(group_id, status); a status that there is not raises."""
        status = F.when(F.col("status").isin(*STATUSES), F.col("status")).otherwise(F.raise_error(F.concat(F.lit("no such status: "), F.coalesce("status", F.lit("null")))))
        return self._append(changes, "status", F.col("group_id"), F.lit(""), status)

    def resolve(self, entries: DataFrame) -> str:
        """(entry_id): entries that are no longer ambiguous. No match is made."""
        return self._append(entries, "resolved", F.col("entry_id"), F.lit(""), F.lit("yes"))

    def comment(self, comments: DataFrame) -> str:
        """(group_id, text)."""
        return self._append(comments, "comment", F.col("group_id"), F.lit(""), F.col("text"))

    def record_run(self, result: MatchResult, run_id: str, counts: DataFrame | None = None) -> str:
        """A run, one row for each book, with its summary (or `counts`: book and any columns) as JSON."""
        from ledgerloom.plans.engine import summary

        told = counts if counts is not None else summary(result)
        rows = told.select(F.struct(F.lit(run_id).alias("run_id"), *told.columns).alias("_run"))
        return self._append(rows, "run", F.lit(run_id), F.lit(""), F.to_json("_run"))

    # what the changes add up to

    def changes(self) -> DataFrame:
        """All changes of live pieces; where pieces overlap, once or more."""
        live = self.live()
        return self.spark.read.schema(CHANGE).parquet(*[f"{self.path}/{name}/rows" for name in live]) if live else self.spark.createDataFrame([], CHANGE)

    def state(self) -> DataFrame:
        """The changes that count: the last one of each key and field where the last wins, each of the others once. Every task keeps one change a key before the shuffle, so a key that is changed often is no hot one."""
        told = self.changes()
        whole = F.struct(*[F.col(x.split()[0]) for x in CHANGE.split(", ")])
        one = F.when(F.col("kind").isin(*LAST_WINS), F.lit("")).otherwise(F.col("change_id"))
        return told.groupBy("kind", "key", "field", one.alias("one")).agg(F.max_by(whole, F.struct(*_ORDER)).alias("last")).select("last.*")

    def statuses(self) -> DataFrame:
        """(group_id, status)."""
        return self.state().where("kind = 'status'").select(F.col("key").alias("group_id"), F.col("value").alias("status"))

    def overrides(self) -> DataFrame:
        """(id, EDITABLE): what edits have set, null where nothing was."""
        set_to = [F.max(F.when(F.col("field") == c, F.col("value"))).cast(kind).alias(c) for c, kind in EDITABLE.items()]
        return self.state().where("kind = 'edit'").groupBy(F.col("key").alias("id")).agg(*set_to)

    def resolved(self) -> DataFrame:
        """(entry_id)."""
        return self.state().where("kind = 'resolved'").select(F.col("key").alias("entry_id"))

    def comments(self) -> DataFrame:
        """(group_id, text, author, at, seq, change_id); a group's comments are in the order of at, seq and change_id."""
        return self.state().where("kind = 'comment'").select(F.col("key").alias("group_id"), F.col("value").alias("text"), "author", *_ORDER)

    def runs(self, most: int = 50) -> DataFrame:
        """(run_id, at, summary as JSON): the latest rows of runs, the last one first."""
        return self.state().where("kind = 'run'").orderBy(*[F.desc(c) for c in _ORDER]).select(F.col("key").alias("run_id"), "at", F.col("value").alias("summary")).limit(most)

    def apply(self, result: MatchResult) -> MatchResult:
        """A result as it is after all changes: groups with their statuses, ledgers with edits and amounts that follow them, ambiguity without what is resolved. Matching is not done again."""
        sides = []
        for ledger in (result.ledger_a, result.ledger_b):
            missing = {c: F.lit(None).cast(kind) for c, kind in EDITABLE.items() if c not in ledger.columns}
            sides.append(report.apply_overrides(ledger.withColumns(missing) if missing else ledger, self.overrides()))
        left = lambda df: df.join(self.resolved(), "entry_id", "left_anti").select(*df.columns)
        return replace(result, groups=report.set_status(result.groups, self.statuses()), ledger_a=sides[0], ledger_b=sides[1], ambiguous=left(result.ambiguous), ambiguous_counts=left(result.ambiguous_counts))

    # housekeeping

    def compact(self) -> str | None:
        """One piece with the state of all live ones, in their place. Nothing is deleted, so readers are not disturbed; None where fewer than two pieces are live."""
        live = self.live()
        if len(live) < 2:
            return None
        rows = self.state()  # lists the live pieces anew: it may hold more than is replaced, never less
        return self._write(rows, live, f"state-{uuid.uuid4().hex}")

    def vacuum(self) -> int:
        """Delete the pieces that others replace; how many. Queries that still read them fail, so it is run when none are. Pieces that are not complete are left: someone may be writing them."""
        pieces = self._complete()
        gone = sorted(set(pieces) & set().union(*pieces.values()))
        for name in gone:
            self._files.delete(self._place(name), True)
        return len(gone)
