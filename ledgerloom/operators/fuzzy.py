"""Pass 3: entries of equal amount within tolerance whose descriptions are alike, best pairs first."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.config import MatchConfig
from ledgerloom.functions import bounds as bounds_of
from ledgerloom.functions import scoring as S
from ledgerloom.functions import text as X
from ledgerloom.operators.buckets import near_cells, near_pairs
from ledgerloom.operators.settle import settle
from ledgerloom.scratch import materialize

#: Candidates share at least so many distinct trigrams.
SHARED = 2
#: Where A has more than SMALL entries, equal sorted words come first, and then entries choose among their best MOST pairs of a cell, by phases. Of equal entries, each may see so many more as EQUALS stand before it.
SMALL, MOST, EQUALS = 20_000, 12, 48


_KEEP = ["book", "id", "row_index", "amount_abs", "date", "ref_number"]
#: So many pairs are looked at in one step, for so many entries of A that are next to each other by amount.
BLOCK, ROWS = 500_000, 64
#: What the function of a cell says of a pair.
_FOUND = T.StructType([T.StructField(n, k) for n, k in (("similarity", T.DoubleType()), ("jaccard", T.DoubleType()), ("place", T.LongType()), ("a_cut", T.BooleanType()), ("b_cut", T.BooleanType()))])


def _forms(a: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Entries with the normal forms of their descriptions, which are made once for each."""
    parts = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = F.col("description")

    def with_forms(side: DataFrame) -> DataFrame:
        dealt = side.where(F.length("description") > 2).repartition(parts)  # what the passes before left may lie in a few files
        made = dealt.select(*_KEEP, F.lower(d).alias("low"), X.normalize_tokens(d).alias("text"), X.normalize_ngrams(d).alias("flat"))
        words = F.filter(F.split("text", " "), lambda t: t != "")
        return made.withColumn("sorted", F.array_join(F.array_sort(words), " "))

    return materialize(with_forms(a), "fuzzy-a"), materialize(with_forms(b), "fuzzy-b")


def _side(table: pa.Table) -> dict[str, np.ndarray]:
    """What bounds the similarities of a cell's entries, as arrays."""
    low, text = table["low"].to_pylist(), table["sorted"].to_pylist()
    size = lambda of: np.array([len(t) for t in of], "int64")
    made = {"amount_abs": table["amount_abs"].to_numpy(), "chars": size(low), "long": size(text), "codes": bounds_of.codes(text)}
    made |= {"start": np.array([hash(t[:4]) for t in low], "int64"), "first": np.array([hash(t[:1]) for t in low], "int64")}  # as hashes; equal ones only loosen a bound
    return made | dict(zip(bounds_of.SETS, bounds_of.character_sets(text), strict=True))


def _winkler_bound(x: dict[str, np.ndarray], y: dict[str, np.ndarray], i: np.ndarray, j: np.ndarray, of_a: np.ndarray, of_b: np.ndarray) -> np.ndarray:
    """A bound of Jaro-Winkler where so many characters of either text are not in the other one."""
    common = np.minimum(x["chars"][i] - of_a, y["chars"][j] - of_b)
    jaro = (common / x["chars"][i] + common / y["chars"][j] + 1) / 3
    return 1 - (1 - jaro) * np.where(x["start"][i] == y["start"][j], 0.6, np.where(x["first"][i] == y["first"][j], 0.7, 1.0))


def _near(x: dict[str, np.ndarray], y: dict[str, np.ndarray], config: MatchConfig, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (place in A, place in B) within the amount tolerance whose characters, counted once each, allow the threshold. Entries of A next to each other by amount look at one run of entries of B."""
    weights, mode, percent, fixed = config.description_weight, config.amount_tolerance_mode, config.amount_tolerance_percent, config.amount_tolerance_fixed
    by_a, by_b = np.argsort(x["amount_abs"], kind="stable"), np.argsort(y["amount_abs"], kind="stable")
    amounts, others = x["amount_abs"][by_a], y["amount_abs"][by_b]
    one = lambda side, order: [side[n][order].astype("float32") for n in ("chars", "long")]
    (chars_a, long_a), (chars_b, long_b) = one(x, by_a), one(y, by_b)
    set_a, set_b = x[bounds_of.SETS[0]][by_a].view("uint64"), y[bounds_of.SETS[0]][by_b].view("uint64")
    first_a, first_b = x["first"][by_a], y["first"][by_b]
    wide = config.fixed + 1e-9
    step = max(1, min(ROWS, BLOCK // max(len(others), 1)))
    for at in range(0, len(amounts), step):
        own = slice(at, at + step)
        least, most = amounts[own][0], amounts[own][-1]
        start, end = np.searchsorted(others, min(least * (1 - config.percent), least - wide) * (1 - 1e-9)), np.searchsorted(others, max(most / (1 - config.percent), most + wide) * (1 + 1e-9), "right")
        if start == end:
            continue
        run = slice(start, end)
        s, t = set_a[own, None], set_b[None, run]
        of_a, of_b = np.bitwise_count(s & ~t), np.bitwise_count(t & ~s)
        common = np.minimum(chars_a[own, None] - of_a, chars_b[None, run] - of_b)
        jaro = common * (1 / chars_a[own, None] + 1 / chars_b[None, run])  # three times the bound of Jaro, but for the one that is added
        bound = (jaro - 2) * (np.where(first_a[own, None] == first_b[None, run], np.float32(0.6), np.float32(1)) * np.float32(weights.jaro_winkler / 3))
        unlike = np.maximum(np.maximum(of_a, of_b), np.abs(long_a[own, None] - long_b[None, run]))
        bound -= unlike / np.maximum(np.maximum(long_a[own, None], long_b[None, run]), 1) * np.float32(weights.token_sort)
        i, j = np.nonzero(bound >= np.float32(threshold - weights.jaro_winkler - weights.token_sort - weights.token_containment - 1e-4))
        p, q = amounts[own][i], others[run][j]
        difference = np.abs(p - q)
        by = {"percent": lambda: difference <= np.maximum(p, q) * percent, "fixed": lambda: difference <= fixed}  # noqa: B023
        kept = by["percent"]() | by["fixed"]() if mode == "both" else by[mode]()
        yield by_a[own][i[kept]], by_b[run][j[kept]]


def _reachable(config: MatchConfig, threshold: float) -> Callable[[pa.Table, pa.Table], tuple[np.ndarray, ...]]:
    """The pairs of a cell's entries of A and of B within the amount tolerance that can still reach the threshold, as a function of both tables:
    (place in A, place in B, Jaro-Winkler or a bound, distance of the sorted words or a bound, bound of the similarity).

    Characters that only one text has bound Jaro-Winkler (no more than the others are common) and the distance of the sorted words (each edit mends one at most). Bounds go from cheap to dear, each
    for the pairs that the one before leaves: characters, words, the distance itself, Jaro-Winkler itself. Texts beyond LONGEST characters keep their bounds.
    """
    weights = config.description_weight

    def pairs(a: pa.Table, b: pa.Table) -> tuple[np.ndarray, ...]:
        x, y = _side(a), _side(b)
        near = list(_near(x, y, config, threshold))
        if not sum(len(i) for i, _ in near):
            return tuple(np.empty(0, kind) for kind in ("int64", "int64", "float64", "int64", "float64"))
        every = tuple(np.unique(np.concatenate([pair[side] for pair in near])) for side in (0, 1))
        of = lambda name: (table[name].take(pa.array(rows)).to_pylist() for table, rows in zip((a, b), every, strict=True))
        asked, given = ([t.split() for t in texts] for texts in of("text"))
        words_a, words_b = bounds_of.words_of([[t for t in words if len(t) >= 2] for words in asked], bounds_of.WORDS), bounds_of.words_of([list(dict.fromkeys(words)) for words in given], bounds_of.GIVEN)
        stands = bounds_of.places(x["codes"])
        low_a, low_b = ([t[: bounds_of.LONGEST] for t in texts] for texts in of("low"))
        found = []
        for i, j in _blocks(near):
            of_a = of_b = np.zeros(len(i), "int64")
            for name in bounds_of.SETS:
                of_a, of_b = of_a + bounds_of.beyond(x[name][i], y[name][j]), of_b + bounds_of.beyond(y[name][j], x[name][i])
            winkler = _winkler_bound(x, y, i, j, of_a, of_b)
            unlike = np.maximum(np.maximum(of_a, of_b), np.abs(x["long"][i] - y["long"][j]))
            contained, p, q = np.ones(len(i)), *(np.searchsorted(rows, at) for rows, at in zip(every, (i, j), strict=True))
            for known in ("characters", "words", "some", "all", "distance", "winkler"):
                if known == "words":
                    contained = bounds_of.containment(words_a, words_b, p, q)
                elif known in ("some", "all"):
                    contained = np.minimum(contained, bounds_of.found(words_a, words_b, p, q, known == "all"))
                elif known == "distance":
                    short = np.nonzero((x["long"][i] <= bounds_of.LONGEST) & (y["long"][j] <= bounds_of.LONGEST))[0]
                    unlike[short] = bounds_of.distances(stands, x["long"], y["codes"], y["long"], i[short], j[short])
                elif known == "winkler":
                    short = np.nonzero((x["chars"][i] <= bounds_of.LONGEST) & (y["chars"][j] <= bounds_of.LONGEST))[0]
                    exact = bounds_of.winklers(low_a, low_b, p[short], q[short])
                    if exact is not None:
                        winkler[short] = exact
                ratio = 1 - unlike / np.maximum(np.maximum(x["long"][i], y["long"][j]), 1)
                bound = winkler * weights.jaro_winkler + ratio * weights.token_sort + contained * weights.token_containment
                kept = bound >= threshold - 1e-9
                i, j, p, q, winkler, unlike, contained, bound = (v[kept] for v in (i, j, p, q, winkler, unlike, contained, bound))
            found.append((i, j, winkler, unlike, bound))
        return tuple(np.concatenate(column) for column in zip(*found, strict=True))

    return pairs


def _blocks(near: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of pairs put together, about BLOCK pairs at a time."""
    held, many = [], 0
    for pair in near:
        held.append(pair)
        many += len(pair[0])
        if many >= BLOCK:
            yield tuple(np.concatenate(side) for side in zip(*held, strict=True))
            held, many = [], 0
    if many:
        yield tuple(np.concatenate(side) for side in zip(*held, strict=True))


def _grams(flat: str) -> dict[str, int]:
    """The distinct trigrams of an n-gram form in order, with their places; a shorter text is its only one."""
    return {g: k for k, g in enumerate(dict.fromkeys(flat[k : k + 3] for k in range(max(len(flat) - 2, 1))))} if flat else {}


def _exact(a: pa.Table, b: pa.Table, config: MatchConfig, threshold: float) -> Callable[[int, int, float, int], tuple[float, float, int]]:
    """(similarity, jaccard, place) of a pair of a cell, given its Jaro-Winkler similarity (a bound for long texts) and its distance of sorted words; a similarity of -1 if it is below the threshold or too few trigrams are shared."""
    weights = config.description_weight
    of_a, of_b = ({n: t[n].to_pylist() for n in ("low", "sorted", "text", "flat")} for t in (a, b))
    made = [{}, {}]

    def forms(side: int, at: int) -> tuple:
        known = made[side].get(at)
        if known is None:
            of = (of_a, of_b)[side]
            words = of["text"][at].split()
            known = made[side][at] = ([t for t in words if len(t) >= 2] if side == 0 else list(dict.fromkeys(words)), _grams(of["flat"][at]))
        return known

    def score(i: int, j: int, winkler: float, unlike: int) -> tuple[float, float, int]:
        p, q = of_a["sorted"][i], of_b["sorted"][j]
        longer = max(len(p), len(q))
        if longer > bounds_of.LONGEST:
            unlike = X.distance(p, q)
        words = (1 - unlike / longer if longer else 1.0) * weights.token_sort
        (asked, own), (given, other) = forms(0, i), forms(1, j)
        found = X.contained(asked, of_b["text"][j], given) * weights.token_containment
        if winkler * weights.jaro_winkler + words + found < threshold - 1e-9:
            return -1.0, 0.0, 0
        total = min(1.0, X.winkler(of_a["low"][i], of_b["low"][j]) * weights.jaro_winkler + words + found)
        if total < threshold:
            return -1.0, 0.0, 0
        shared = [own[g] for g in own if g in other]
        return (total, len(shared) / (len(own) + len(other) - len(shared)), shared[0] + 1) if len(shared) >= SHARED else (-1.0, 0.0, 0)

    return score


def _rank(*keys: np.ndarray) -> np.ndarray:
    """Each row's place among the rows of equal first key, by the other keys."""
    order = np.lexsort(keys[::-1])
    of = keys[0][order]
    first = np.r_[True, of[1:] != of[:-1]] if len(of) else np.empty(0, bool)
    ranks = np.empty(len(order), "int64")
    ranks[order] = np.arange(len(order)) - np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
    return ranks


def _alike(config: MatchConfig, threshold: float, names: list[str], most: int | None) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The pairs of a cell of at least the threshold, with all that their order depends on; if `most` is given, those that are among the first so many of either entry, in the order of the sweep.

    A pair that is the last one kept of an entry which has more is marked (a_cut, b_cut): no pair of that entry before it is left out. Pairs whose bound is below what the first ones of
    both their entries have are not scored.
    """
    near = _reachable(config, threshold)

    def limits(table: pa.Table) -> np.ndarray:
        """How many pairs each entry may have: entries of equal texts want the same ones, one after the other."""
        equal = np.unique(np.array(table["low"].to_pylist(), object).astype(str), return_inverse=True)[1]
        return most + np.minimum(_rank(equal, table["row_index"].to_numpy()), EQUALS)

    def pairs(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            a, b = a.slice(0, 0), b.slice(0, 0)
            i = j = np.empty(0, "int64")
            winkler, unlike, bound = np.empty(0), i, np.empty(0)
        else:
            i, j, winkler, unlike, bound = near(a, b)
        scores = np.full((len(i), 3), -1.0)
        known = np.zeros(len(i), bool)
        score = _exact(a, b, config, threshold) if len(i) else None

        def settle_scores(at: np.ndarray) -> None:
            known[at] = True
            for k, *pair in zip(at.tolist(), i[at].tolist(), j[at].tolist(), winkler[at].tolist(), unlike[at].tolist(), strict=True):
                scores[k] = score(*pair)

        cut_a, cut_b = np.zeros(len(i), bool), np.zeros(len(i), bool)
        if most is None or not len(i):
            settle_scores(np.arange(len(i)))
            kept = scores[:, 0] >= 0
        else:
            may_a, may_b = limits(a), limits(b)
            settle_scores(np.nonzero((_rank(i, -bound) < 2 * may_a[i]) | (_rank(j, -bound) < 2 * may_b[j]))[0])
            least = []
            for of, may in ((i, may_a), (j, may_b)):
                last = np.full(len(may), -1.0)
                at = np.nonzero(scores[:, 0] >= 0)[0]
                nth = at[_rank(of[at], -scores[at, 0]) == may[of[at]] - 1]
                last[of[nth]] = scores[nth, 0]
                least.append(last[of])
            settle_scores(np.nonzero(~known & (bound + 1e-9 >= np.minimum(*least)))[0])
            at = np.nonzero(scores[:, 0] >= 0)[0]
            similarity, jaccard, place = scores[at].T
            row_a, row_b = a["row_index"].to_numpy()[i[at]], b["row_index"].to_numpy()[j[at]]
            rank_a, rank_b = _rank(i[at], -similarity, -jaccard, place, row_b), _rank(j[at], -similarity, row_a, -jaccard, place)
            kept = np.zeros(len(i), bool)
            kept[at] = (rank_a < may_a[i[at]]) | (rank_b < may_b[j[at]])
            left_out = (~known) | ((scores[:, 0] >= 0) & ~kept)
            more_a, more_b = np.bincount(i[left_out], minlength=a.num_rows) > 0, np.bincount(j[left_out], minlength=b.num_rows) > 0
            cut_a[at], cut_b[at] = (rank_a == may_a[i[at]] - 1) & more_a[i[at]], (rank_b == may_b[j[at]] - 1) & more_b[j[at]]
        left, right = a.take(pa.array(i[kept])), b.take(pa.array(j[kept]))
        told = [scores[kept, 0], scores[kept, 1], scores[kept, 2].astype("int64"), cut_a[kept], cut_b[kept]]
        return pa.table([*[left[n[2:]] if n[0] == "a" else right[n[2:]] for n in names], *map(pa.array, told)], names=[*names, *_FOUND.names])

    return pairs


def _similar(left: DataFrame, right: DataFrame, config: MatchConfig, threshold: float, most: int | None = None) -> DataFrame:
    """Pairs of entries (with their forms) of at least the threshold. Similarities of 1 are asked for by equal sorted words, others cell by cell; see _alike for `most`."""
    weights = config.description_weight
    if weights.token_sort > 0 and threshold - weights.jaro_winkler - weights.token_containment > weights.token_sort * (1 - 1e-7):  # descriptions have fewer than ten million characters
        fits = S.amounts_match(F.col("a_amount_abs"), F.col("b_amount_abs"), config) & (F.col("a_sorted") == F.col("b_sorted"))
        # Written, as the planner would else move all that follows into the join's condition, which is then interpreted pair by pair.
        near = materialize(near_pairs(left, right, config, False, fits), "fuzzy-near")
        words = {"a_asked": F.filter(F.split("a_text", " "), lambda t: F.length(t) >= 2), "b_given": F.array_distinct(F.filter(F.split("b_text", " "), lambda t: t != ""))}
        grams = {f"{p}_grams": F.array_distinct(X.cut_ngrams(F.col(f"{p}_flat"))) for p in "ab"}
        near = near.withColumns(words | grams)
        sort = X.sorted_ratio(F.col("a_sorted"), F.col("b_sorted")) * weights.token_sort
        found = X.words_contained(F.col("a_asked"), F.col("b_text"), F.col("b_given")) * weights.token_containment
        total = F.least(F.lit(1.0), X.jaro_winkler(F.col("a_low"), F.col("b_low")) * weights.jaro_winkler + sort + found)
        shared = F.size(F.array_intersect("a_grams", "b_grams"))
        alike = near.withColumns({"similarity": total, "_shared": shared}).where((F.col("similarity") >= threshold) & (F.col("_shared") >= SHARED))
        jaccard = F.col("_shared") / (F.size("a_grams") + F.size("b_grams") - F.col("_shared"))
        place = F.array_position(F.transform("a_grams", lambda g: F.array_contains(F.col("b_grams"), g)), F.lit(True))
        scored = alike.withColumns({"jaccard": jaccard, "place": place, "a_cut": F.lit(False), "b_cut": F.lit(False)})
    else:
        names = [f"{p}_{n}" for p in "ab" for n in _KEEP]
        types = {f"{p}_{f.name}": f.dataType for p, side in (("a", left), ("b", right)) for f in side.schema}
        schema = T.StructType([*[T.StructField(n, types[n]) for n in names], *_FOUND.fields])
        scored = near_cells(left, right, config).applyInArrow(_alike(config, threshold, names, most), schema)
    return materialize(
        scored.select(
            F.col("a_book").alias("book"), "a_id", "a_row_index", "b_id", "b_row_index", "a_amount_abs", "b_amount_abs",
            F.abs(F.col("a_amount_abs") - F.col("b_amount_abs")).alias("diff"), S.day_difference(F.col("a_date"), F.col("b_date")).alias("days"),
            S.refs_match(F.col("a_ref_number"), F.col("b_ref_number"), config.case_sensitive_ref).alias("ref"), *_FOUND.names,
        ),
        "fuzzy-candidates",
    )


def similar_pairs(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """Pairs within the amount tolerance that share trigrams and whose descriptions are similar enough. Dates do not exclude a pair.

    The amount is joined first; trigrams and words are made once for each entry. Bounds decide which pairs can still reach the threshold; only those are scored.
    """
    return _similar(*_forms(a, b), config, config.description_threshold).drop("a_cut", "b_cut")


def _one_round(live: DataFrame):
    """A pair that is first for both of its entries is taken by the sweep whatever comes before, unless it is open; those are taken at once, and their entries leave."""
    of_a = live.groupBy("book", "a_id").agg(F.min("o").alias("o_a"))
    of_b = live.groupBy("book", "b_id").agg(F.min("o").alias("o_b"))

    def rest(taken: DataFrame) -> DataFrame:
        return live.join(taken.select("book", "a_id"), ["book", "a_id"], "left_anti").join(taken.select("book", "b_id"), ["book", "b_id"], "left_anti")

    return live.join(of_a, ["book", "a_id"]).join(of_b, ["book", "b_id"]).where("o = o_a AND o = o_b AND NOT open").drop("o_a", "o_b"), rest


def best_first(pairs: DataFrame) -> DataFrame:
    """The pairs that a sweep over all of them in order, taking each whose entries are both free, would take.

    Where pairs are cut short (a_cut, b_cut), a pair beyond the last one that is known of an entry is open: others that are not listed may come before it. Whatever depends on an open pair is not taken.
    """
    ordered = pairs.withColumn("o", F.struct(-F.col("similarity"), "a_row_index", -F.col("jaccard"), "place", "b_row_index"))
    beyond = F.lit(False)
    if "a_cut" in pairs.columns:
        for side in "ab":
            last = ordered.where(f"{side}_cut").groupBy("book", f"{side}_id").agg(F.min("o").alias(f"_last_{side}"))
            ordered = ordered.join(last, ["book", f"{side}_id"], "left")
            beyond = beyond | F.coalesce(F.col("o") > F.col(f"_last_{side}"), F.lit(False))
    ordered = ordered.select(*pairs.columns, "o", beyond.alias("open"))
    ordered_names = ordered.columns

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        component, used, waiting = None, set(), set()
        for batch in batches:
            chosen = []
            column = lambda k, batch=batch: batch.column(batch.schema.get_field_index(k)).to_pylist()
            for i, (of, x, y, beyond) in enumerate(zip(column("component"), column("a_id"), column("b_id"), column("open"), strict=True)):
                if of != component:
                    component, used, waiting = of, set(), set()
                p, q = (0, x), (1, y)
                if p in used or q in used:
                    continue
                if beyond or p in waiting or q in waiting:
                    waiting |= {p, q}
                else:
                    used |= {p, q}
                    chosen.append(i)
            if chosen:
                yield batch.select(ordered_names).take(pa.array(chosen))

    return settle(ordered, _one_round, [F.col("o")], sweep, ordered.schema).drop("o", "open")


def _unsettled(pairs: DataFrame, taken: DataFrame, side: str) -> DataFrame:
    """(book, id): entries that are free and have pairs that were not listed, or that the sweep left open."""
    free = pairs
    for of in "ab":
        free_of = free.join(taken.select("book", f"{of}_id"), ["book", f"{of}_id"], "left_anti")
        if of == side:
            cut = pairs.where(f"{side}_cut").join(taken.select("book", f"{side}_id"), ["book", f"{side}_id"], "left_anti")
        free = free_of
    return free.select("book", F.col(f"{side}_id").alias("id")).unionByName(cut.select("book", F.col(f"{side}_id").alias("id"))).distinct()


def chosen_pairs(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """The pairs that the sweep over all similar pairs takes.

    Where there are many entries, those of equal sorted words come first, found by an equality join: the sweep goes by similarity before all else, so what they take stands. Then all others list their
    best pairs, and what follows from these is taken; entries whose lists were too short go on, phase by phase. So pairs of near amounts are formed once for most entries, and those that are listed grow with the entries.
    """
    left, right = _forms(a, b)
    last = config.description_threshold
    if left.count() <= SMALL:
        return best_first(_similar(left, right, config, last).drop("a_cut", "b_cut"))
    found = [materialize(best_first(_similar(left, right, config, 1.0).drop("a_cut", "b_cut")), "fuzzy-chosen")]
    used = lambda side: found[0].select("book", F.col(f"{side}_id").alias("id"))
    left, right = (materialize(rest.join(used(side), ["book", "id"], "left_anti").select(*rest.columns), f"fuzzy-{side}") for rest, side in ((left, "a"), (right, "b")))
    columns = found[0].columns
    while True:
        pairs = _similar(left, right, config, last, MOST)
        taken = materialize(best_first(pairs), "fuzzy-chosen")
        found.append(taken.select(*columns))
        if pairs.where("a_cut OR b_cut").isEmpty():
            return reduce(DataFrame.unionByName, found)
        left, right = (materialize(rest.join(_unsettled(pairs, taken, side), ["book", "id"], "left_semi").select(*rest.columns), f"fuzzy-{side}") for rest, side in ((left, "a"), (right, "b")))


def fuzzy_groups(a: DataFrame, b: DataFrame, config: MatchConfig) -> DataFrame:
    """The match groups of pass 3."""
    base = F.greatest("a_amount_abs", "b_amount_abs")
    return chosen_pairs(a, b, config).select(
        "book", "a_id", "b_id", F.lit("fuzzy").alias("match_type"), S.confidence_fuzzy(F.col("similarity"), F.col("days"), F.col("diff"), base, F.col("ref")).alias("confidence"),
        S.reason_fuzzy(F.col("similarity"), F.col("days"), F.col("diff"), base).alias("match_reason"), F.col("diff").alias("amount_difference"), F.col("days").alias("date_difference"),
        F.col("similarity").alias("description_similarity"), F.lit(3).alias("pass_number"),
    )
