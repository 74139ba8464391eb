"""Pass 2: entries whose amount and date are within tolerance, if there is just one candidate.

Candidates are edges between classes of entries, not pairs of entries: entries of a side with equal book, amount and date have the same candidates. An entry takes a candidate only where
that is the last one it sees, so of a class of two or more entries of B none is ever taken, and whoever sees such a class is ambiguous whatever the others do. So the ordered choices
concern only entries of A all of whose classes of B have one member, and a pair is listed for each of those classes. What is ambiguous is kept as edges between classes, the members of
classes, and when a single one was taken; `Ambiguous.candidates` lists it entry by entry when that is asked for, `Ambiguous.counts` only counts. Edges are counted for each class of A and
formed again where they are needed, as they are as many as the product of the classes where amounts are dense.

The same holds for an entry with two candidates that nobody can ever take. `takers` finds who may take one at all, so in dense ledgers few pairs are left for the ordered choices.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.functions import scoring as S
from ledgerloom.operators.buckets import amount_bucket, near_pairs
from ledgerloom.operators import settle as choices
from ledgerloom.operators.settle import settle
from ledgerloom.scratch import materialize


def amount_window(x: Column, y: Column, config: MatchConfig) -> Column:
    """y matches x, and is no higher than x and the larger of both tolerances of x, whatever the mode."""
    return S.amounts_match(x, y, config) & (y <= x + F.greatest(x * config.amount_tolerance_percent, F.lit(config.amount_tolerance_fixed)))


def candidates(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """All pairs within tolerance, with their differences."""
    fits = amount_window(F.col("a_amount_abs"), F.col("b_amount_abs"), config) & S.dates_match(F.col("a_date"), F.col("b_date"), config.date_tolerance_days)
    pairs = near_pairs(a, b, config, True, fits)
    return pairs.select(
        F.col("a_book").alias("book"), "a_id", "a_row_index", "b_id", "b_row_index", "a_amount_abs", "b_amount_abs",
        F.abs(F.col("a_amount_abs") - F.col("b_amount_abs")).alias("diff"), S.day_difference(F.col("a_date"), F.col("b_date")).alias("days"),
        S.refs_match(F.col("a_ref_number"), F.col("b_ref_number"), config.case_sensitive_ref).alias("ref"),
    )


_PAIR = "book long, a_id string, a_row_index long, b_id string, b_row_index long, a_amount_abs double, b_amount_abs double, diff double, days int, ref boolean"


def _one_round(live: DataFrame):
    """An entry is ready when no undecided entry before it shares a candidate with it; all ready entries are decided at once."""
    first = live.groupBy("book", "b_id").agg(F.min("a_row_index").alias("first"))
    seen = live.join(first, ["book", "b_id"])
    ready = seen.groupBy("book", "a_id").agg(F.min((F.col("a_row_index") == F.col("first")).cast("int")).alias("ready"), F.count("*").alias("live")).where("ready = 1").drop("ready")

    def rest(decided: DataFrame) -> DataFrame:
        taken = decided.where("live = 1").select("book", "b_id")
        return live.join(decided.select("book", "a_id").distinct(), ["book", "a_id"], "left_anti").join(taken, ["book", "b_id"], "left_anti")

    return live.join(ready, ["book", "a_id"]), rest


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The loop over entries of A of one component after the other. Held are the entries of B that the component has taken, and the candidates of one entry."""
    names = [*(x.split()[0] for x in _PAIR.split(", ")), "live"]
    component, entry, taken, own = None, None, set(), []

    def decided() -> list[tuple]:
        free = [row for row in own if row[3] not in taken]
        if len(free) == 1:
            taken.add(free[0][3])
        return [(*row, len(free)) for row in free]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS)], names=names)

    out: list[tuple] = []
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (*names[:-1], "component")]
        for *row, of in zip(*columns, strict=True):
            if (of, row[1]) != (component, entry):
                out += decided()
                own = []
                if of != component:
                    taken = set()
                component, entry = of, row[1]
            own.append(tuple(row))
        if out:
            yield batch_of(out)
            out = []
    out = decided()
    if out:
        yield batch_of(out)


_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int32(), pa.bool_(), pa.int64()]


def decide(pairs: DataFrame) -> DataFrame:
    """The candidates of each entry of A at its turn, with their number `live`, as if entries of A came one after the other and took a sole candidate away."""
    return settle(pairs, _one_round, [F.col("a_row_index"), F.col("a_id")], _in_order, f"{_PAIR}, live long")


def _scored(decided: DataFrame) -> DataFrame:
    base = F.greatest("a_amount_abs", "b_amount_abs")
    return decided.select(
        "book", "a_id", "b_id", "a_row_index", "b_row_index", "b_amount_abs", "live", S.confidence_amount_date(F.col("days"), F.col("diff"), base, F.col("ref")).alias("confidence"),
        S.reason_amount_date(F.col("days"), F.col("diff"), base, F.col("ref")).alias("match_reason"), F.col("diff").alias("amount_difference"), F.col("days").alias("date_difference"),
    )


_CLASS = ["book", "amount_abs", "date"]
#: Edges are written for classes of A that see so many classes of B at most.
LISTED = 16
#: So many buckets of amounts next to each other are looked at by one call.
NEXT = 16


def classes(side: DataFrame) -> DataFrame:
    """(book, amount_abs, date, n, id, row_index, ref_number): entries that have the same candidates, their number, and one of them, which is the only one where n is 1."""
    one = F.min(F.struct("row_index", "id", "ref_number"))
    return side.groupBy(*_CLASS).agg(F.count("*").alias("n"), one.alias("one")).select(*_CLASS, "n", "one.id", "one.row_index", "one.ref_number")


def _edges(a: DataFrame, b: DataFrame, config: MatchConfig, around: str = "b") -> DataFrame:
    """Edges between classes of A and of B whose entries are within tolerance: columns of both with a_ and b_. See near_pairs for `around`."""
    fits = amount_window(F.col("a_amount_abs"), F.col("b_amount_abs"), config) & S.dates_match(F.col("a_date"), F.col("b_date"), config.date_tolerance_days)
    return near_pairs(a, b, config, True, fits, around)


def class_edges(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """The edges between the classes of the entries of A and of B."""
    return _edges(classes(a).drop("row_index", "ref_number"), classes(b), config)


def candidate_classes(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """All pairs of `candidates` as pairs of classes and their members: (kind, id, class_id, ref, diff, days).

    A row of kind `a` or `b` is an entry of that side, the representative of its class (the entry of least row number) and its reference's letters and digits; one of kind `link` says that all members of the class `id`
    of A and of the class `class_id` of B are within tolerance, and their differences. The references of a pair match where those of its members are equal. So copies add rows, not pairs.
    """
    none = lambda kind: F.lit(None).cast(kind)
    links = class_edges(a, b, config).select(
        F.lit("link").alias("kind"), F.col("a_id").alias("id"), F.col("b_id").alias("class_id"), none("string").alias("ref"), F.abs(F.col("a_amount_abs") - F.col("b_amount_abs")).alias("diff"),
        S.day_difference(F.col("a_date"), F.col("b_date")).alias("days"),
    )

    def members(side: DataFrame, kind: str) -> DataFrame:
        of = classes(side).select(*[F.col(c).alias(f"_{c}") for c in _CLASS], F.col("id").alias("class_id"))
        same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _CLASS])
        ref = S.normalize_ref(F.col("ref_number"), config.case_sensitive_ref)
        return side.join(of, same).select(F.lit(kind).alias("kind"), "id", "class_id", F.nullif(ref, F.lit("")).alias("ref"), none("double").alias("diff"), none("int").alias("days"))

    return links.unionByName(members(a, "a")).unionByName(members(b, "b"))


def degrees(of_a: DataFrame, of_b: DataFrame, config: MatchConfig) -> DataFrame:
    """The classes of A that have edges, with the number of these (`left`), of the entries of B that they see (`b_total`), and the size of the largest class of those (`most`). Edges are counted where they are formed, not written."""
    return _edges(of_a.select(*_CLASS, "id"), of_b.select(*_CLASS, "n"), config).groupBy(*[f"a_{c}" for c in (*_CLASS, "id")]).agg(F.count("*").alias("left"), F.sum("b_n").alias("b_total"), F.max("b_n").alias("most"))


def takers(seen: DataFrame, classes_b: DataFrame, config: MatchConfig) -> DataFrame:
    """The classes of A (of those that `degrees` tells) that may take a candidate at some order of events; no other ever does.

    A class that sees a class of several takes none. One with a single candidate may take it; so candidates of such classes may be gone when others have their turn, and a class all but one of
    whose candidates may be gone may take one, too, until nothing is added. Edges are written for classes that see up to LISTED; those that see more need that many candidates gone, which are counted
    by joins with what may be gone. So what is written grows with the classes, not with their product.
    """
    key, of_b = [f"a_{c}" for c in (*_CLASS, "id")], ["a_book", "b_id"]
    plain = lambda side: side.select(*[F.col(k).alias(k[2:]) for k in key])
    open_ = materialize(seen.where("most = 1").select(*key, "left"), "open-classes")
    if (open_.agg(F.sum("left")).first()[0] or 0) <= choices.FEW:
        return open_.select(*key)
    single = materialize(classes_b.where("n = 1").select(*_CLASS, "id"), "single-classes")
    block = F.floor(amount_bucket(F.col("a_amount_abs"), config) / NEXT).alias("block")

    def sight(some: DataFrame) -> DataFrame:
        edges = _edges(plain(some), single, config).join(some.select("a_book", "a_id", "left"), ["a_book", "a_id"])
        return materialize(edges.select(*key, "left", "b_id", "b_amount_abs", "b_date", block), "class-edges")

    edges, high = sight(open_.where(F.col("left") <= LISTED)), open_.where(F.col("left") > LISTED)
    asked, able, gone, told = edges, [], [], 0
    known = lambda some: reduce(DataFrame.unionByName, some)
    while True:
        marked = asked.join(known(gone).select(*of_b, F.lit(True).alias("gone")), of_b, "left") if gone else asked.withColumn("gone", F.lit(False))
        marked = marked.select("a_book", "block", "a_id", "left", "b_id", F.coalesce("gone", F.lit(False)).alias("gone"))
        found = materialize(marked.groupBy("a_book", "block").applyInArrow(_spread, "a_book long, kind string, id string"), "takers")
        able.append(found.where("kind = 'a'").select("a_book", F.col("id").alias("a_id")))
        new = asked.join(found.where("kind = 'b'").select("a_book", F.col("id").alias("b_id")), of_b, "left_semi").select(*of_b, "b_amount_abs", "b_date").distinct()
        gone.append(materialize(new.join(known(gone), of_b, "left_anti") if gone else new, "takeable"))
        if gone[-1].isEmpty():
            # Classes that see many are looked at only now: which of their candidates may be gone since they were looked at last.
            since = known(gone[told:]).select(F.col("a_book").alias("book"), F.col("b_amount_abs").alias("amount_abs"), F.col("b_date").alias("date"), F.col("b_id").alias("id"))
            told = len(gone)
            lost = _edges(plain(high), since, config).groupBy("a_book", "a_id").agg(F.count("*").alias("_lost"))
            high = materialize(high.join(lost, ["a_book", "a_id"], "left").select(*key, "left", (F.coalesce("_lost", F.lit(0)) + (F.col("lost") if "lost" in high.columns else F.lit(0))).alias("lost")), "open-classes")
            asked, high = high.where("left - lost <= 1"), high.where("left - lost > 1")
            if asked.isEmpty():
                return open_.select(*key).join(known(able).distinct(), ["a_book", "a_id"], "left_semi")
            asked = sight(asked)
            edges = edges.unionByName(asked)
        else:
            # Blocks of amounts in which a class of others can be gone now.
            asked = edges.join(edges.join(gone[-1].select(*of_b), of_b, "left_semi").select("a_book", "block").distinct(), ["a_book", "block"], "left_semi")


def _spread(edges: pa.Table) -> pa.Table:
    """Of the edges of a block's classes of A: those classes that may take a candidate (kind a), and the candidates that may be gone with them (kind b), as far as these edges and what is gone already (`gone`) tell."""
    (x, ids_a), (y, ids_b) = ((c.indices.to_numpy(), c.dictionary) for c in (edges[name].combine_chunks().dictionary_encode() for name in ("a_id", "b_id")))
    missing, gone = np.zeros(len(ids_a), "int64"), np.zeros(len(ids_b), bool)
    marked = edges["gone"].to_numpy()
    missing[x] = edges["left"].to_numpy()
    gone[y[marked]] = True
    missing -= np.bincount(x[gone[y]], minlength=len(ids_a))
    by_a, by_b = np.argsort(x, kind="stable"), np.argsort(y, kind="stable")
    ends_a, ends_b = np.searchsorted(x[by_a], np.arange(len(ids_a) + 1)), np.searchsorted(y[by_b], np.arange(len(ids_b) + 1))
    able = missing <= 1
    waiting, fresh = np.nonzero(able)[0].tolist(), []
    while waiting:
        of = waiting.pop()
        for candidate in y[by_a[ends_a[of] : ends_a[of + 1]]].tolist():
            if not gone[candidate]:
                gone[candidate] = True
                fresh.append(candidate)
                for other in x[by_b[ends_b[candidate] : ends_b[candidate + 1]]].tolist():
                    missing[other] -= 1
                    if missing[other] <= 1 and not able[other]:
                        able[other] = True
                        waiting.append(other)
    a, b = ids_a.take(pa.array(np.nonzero(able)[0])), ids_b.take(pa.array(fresh, pa.int64()))
    book = pa.array([edges["a_book"][0].as_py()] * (len(a) + len(b)), pa.int64())
    return pa.table({"a_book": book, "kind": pa.array(["a"] * len(a) + ["b"] * len(b), pa.string()), "id": pa.concat_arrays([a, b])})


def _of_class(entries: DataFrame, edges: DataFrame, name: str) -> DataFrame:
    """Entries of a side (its columns prefixed with name) with each edge of their class. Missing dates are equal here."""
    side = entries.select(*[F.col(c).alias(f"{name}_{c}") for c in entries.columns])
    keys = [f"{name}_{c}" for c in _CLASS]
    drawn = edges.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in edges.columns if c not in side.columns])
    same = (F.col(keys[0]) == F.col("_k0")) & (F.col(keys[1]) == F.col("_k1")) & F.col(keys[2]).eqNullSafe(F.col("_k2"))
    return side.join(drawn, same).drop("_k0", "_k1", "_k2")


def _told(pairs: DataFrame, config: MatchConfig) -> DataFrame:
    """Pairs of entries with their differences."""
    return pairs.select(
        F.col("a_book").alias("book"), "a_id", "a_row_index", "b_id", "b_row_index", "a_amount_abs", "b_amount_abs", F.abs(F.col("a_amount_abs") - F.col("b_amount_abs")).alias("diff"),
        S.day_difference(F.col("a_date"), F.col("b_date")).alias("days"), S.refs_match(F.col("a_ref_number"), F.col("b_ref_number"), config.case_sensitive_ref).alias("ref"),
    )


def class_pairs(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """The rows of `candidates`: every pair, drawn from the edges between classes. Tolerances are looked at once for each pair of classes; entries are shuffled by class, and pairs are not shuffled, sorted or written."""
    keep = [*_CLASS, "id", "row_index", "ref_number"]
    edges = materialize(class_edges(a, b, config).drop("a_n", "a_id", "b_n", "b_id", "b_row_index", "b_ref_number"), "class-edges")
    return _told(_of_class(b.select(*keep), _of_class(a.select(*keep), edges, "a"), "b"), config)


@dataclass
class Ambiguous:
    """What pass 2 leaves open: the classes of A that never take one (`static`, with what `degrees` tells), the classes of B, the decisions of all others (`scored`, with the candidates `live` at their turn), and both ledgers."""

    static: DataFrame
    of_b: DataFrame
    scored: DataFrame
    a: DataFrame
    b: DataFrame
    config: MatchConfig

    @property
    def edges(self) -> DataFrame:
        """The edges of the static classes. They are formed where they are read, and nowhere written."""
        return self._edges(self.of_b)

    def _taken(self) -> DataFrame:
        return self.scored.where("live = 1").select(F.col("book").alias("_book"), F.col("b_id").alias("_taken"), F.col("a_row_index").alias("_by"))

    def _edges(self, of_b: DataFrame) -> DataFrame:
        """The edges of the static classes to these of B."""
        return _edges(self.static.select(*[F.col(f"a_{c}").alias(c) for c in _CLASS]), of_b, self.config)

    def counts(self) -> DataFrame:
        """(book, entry_id, n_candidates) of each ambiguous entry: as many rows as entries, however many candidates they have."""
        keys = ["a_book", "a_amount_abs", "a_date"]
        total = self.static.select(*keys, "b_total")
        # Single candidates that an earlier entry has taken do not count.
        taken = self.of_b.where("n = 1").join(self._taken(), (F.col("book") == F.col("_book")) & (F.col("id") == F.col("_taken"))).select(*_CLASS, F.col("_by").alias("by"))
        by = self._edges(taken).groupBy(*keys).agg(F.sort_array(F.collect_list("b_by")).alias("b_gone"))  # no more than the class has edges
        same = lambda x, y: (x[keys[0]] == y[keys[0]]) & (x[keys[1]] == y[keys[1]]) & x[keys[2]].eqNullSafe(y[keys[2]])
        drawn = total.join(by, same(total, by), "left").select(*[total[k] for k in keys], "b_total", "b_gone")
        met = _of_class(self.a.select(*_CLASS, "id", "row_index"), drawn, "a")
        lost = F.size(F.filter(F.coalesce("b_gone", F.array().cast("array<bigint>")), lambda r: r < F.col("a_row_index")))
        static = met.select(F.col("a_book").alias("book"), F.col("a_id").alias("entry_id"), (F.col("b_total") - lost).cast("long").alias("n_candidates"))
        others = self.scored.where("live > 1").groupBy("book", F.col("a_id").alias("entry_id")).agg(F.count("*").alias("n_candidates"))
        return static.unionByName(others)

    def candidates(self) -> DataFrame:
        """(book, entry_id, cand_pos, cand_id, ...): every candidate of every ambiguous entry at its turn, in ascending amount, then order of B. As long as the product of the classes."""
        keep = [*_CLASS, "id", "row_index", "ref_number"]
        pairs = _of_class(self.b.select(*keep), _of_class(self.a.select(*keep), self._edges(self.of_b.select(*_CLASS)), "a"), "b")
        at = _scored(_told(pairs, self.config).withColumn("live", F.lit(2).cast("long")))
        free = at.join(self._taken(), (F.col("book") == F.col("_book")) & (F.col("b_id") == F.col("_taken")) & (F.col("_by") < F.col("a_row_index")), "left_anti")
        rows = free.unionByName(self.scored.where("live > 1"))
        place = F.row_number().over(Window.partitionBy("book", "a_id").orderBy("b_amount_abs", "b_row_index", "b_id")) - 1
        return rows.select("book", F.col("a_id").alias("entry_id"), place.alias("cand_pos"), F.col("b_id").alias("cand_id"), "confidence", "match_reason", "amount_difference", "date_difference")


def amount_date_groups(a: DataFrame, b: DataFrame, config: MatchConfig) -> tuple[DataFrame, Ambiguous]:
    """The match groups of pass 2, and what it leaves open, which stays unmatched."""
    a, b = (side.select(*_CLASS, "id", "row_index", "ref_number") for side in (a, b))
    of_a, of_b = (materialize(classes(side), "classes") for side in (a, b))
    seen = materialize(degrees(of_a, of_b, config), "degrees")
    able = materialize(takers(seen, of_b, config), "takers")
    static = materialize(seen.join(able, ["a_book", "a_id"], "left_anti"), "static")
    single = _edges(able.select(*[F.col(f"a_{c}").alias(c) for c in _CLASS]), of_b, config, "a")
    scored = materialize(_scored(decide(_told(_of_class(a, single, "a"), config))), "amount-date")  # groups and candidates are read one after the other
    groups = scored.where("live = 1").select(
        "book", "a_id", "b_id", F.lit("amount_date").alias("match_type"), "confidence", "match_reason", "amount_difference", "date_difference",
        F.lit(0.0).alias("description_similarity"), F.lit(2).alias("pass_number"),
    )
    return groups, Ambiguous(static, of_b, scored, a, b, config)
