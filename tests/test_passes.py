import datetime
import random
import sys
from collections import Counter
from pathlib import Path

import pytest

from ledgerloom.config import MatchConfig
from ledgerloom.fixtures import ledgers
from ledgerloom.operators import exact, fuzzy, residue, split, tolerance
from ledgerloom.operators.ranking import occurrence_rank
from ledgerloom.plans import engine, report

sys.path.insert(0, str(Path(__file__).parent))
import model  # noqa: E402

SF = "/root/testdata/sf0.001"
SCHEMA = "book long, id string, row_index long, date date, description string, amount double, amount_abs double, amount_cents long, ref_number string"


def ledger(rng, side, n, refs=("", None, "---", "AB-1", "ab1", "X9")):
    rows = []
    for i in range(n):
        cents = rng.choice([100, 101, 102, 250, 251, 500, 750, 1000, 1005, 0])
        day = None if rng.random() < 0.15 else datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(8))
        rows.append({"book": 0, "id": f"{side}:{i}", "row_index": i, "date": day, "description": rng.choice(["rent march", "rent", "salary april", "office supplies", ""]), "amount": cents / 100, "amount_abs": cents / 100, "amount_cents": cents, "ref_number": rng.choice(refs)})
    return rows


def frames(spark, a, b):
    return [spark.createDataFrame([tuple(r.values()) for r in x] or [], SCHEMA) for x in (a, b)]


@pytest.mark.parametrize("cfg", [MatchConfig(), MatchConfig(case_sensitive_ref=True), MatchConfig(ignore_reference_in_exact=True)])
def test_exact_is_the_loop(spark, cfg):
    rng = random.Random(5)
    a, b = ledger(rng, "A", 60), ledger(rng, "B", 60)
    got = {(r.a_id, r.b_id) for r in exact.exact_pairs(*frames(spark, a, b), cfg).collect()}
    assert got == set(model.exact(a, b, cfg))


@pytest.mark.parametrize("cfg", [MatchConfig(), MatchConfig(amount_tolerance_mode="percent", amount_tolerance_percent=0.02), MatchConfig(amount_tolerance_mode="fixed", amount_tolerance_fixed=0.01, date_tolerance_days=1)])
def test_amount_date_is_the_loop(spark, cfg):
    rng = random.Random(7)
    a, b = ledger(rng, "A", 30), ledger(rng, "B", 22)
    for r in a + b:
        r["amount_abs"] = r["amount"] = rng.randrange(100, 2000) / 100
    groups, several = tolerance.amount_date_groups(*frames(spark, a, b), cfg)
    want, ambiguous = model.amount_date(a, b, cfg)
    assert {(r.a_id, r.b_id) for r in groups.collect()} == set(want)
    assert {(r.entry_id, r.cand_pos, r.cand_id) for r in several.candidates().collect()} == set(ambiguous)
    assert {(r.entry_id, r.n_candidates) for r in several.counts().collect()} == set(Counter(e for e, _, _ in ambiguous).items())


def test_amount_date_with_classes_is_the_loop(spark):
    """Few amounts and dates, so that many entries are alike, on both sides; and a class that all see."""
    matched = 0
    for seed in range(2):
        rng = random.Random(seed)
        a, b = ledger(rng, "A", 50), ledger(rng, "B", 30)
        for r in a + b:
            r["amount_abs"] = r["amount"] = rng.choice([1.0, 1.04, 1.08, 1.3, 5.0, 5.2, 9.0])
            r["date"] = None if rng.random() < 0.1 else datetime.date(2024, 1, 1) + datetime.timedelta(days=4 * rng.randrange(12))
        for r in b[:4]:
            r["amount_abs"], r["date"] = 9.0, None
        groups, several = tolerance.amount_date_groups(*frames(spark, a, b), MatchConfig())
        want, ambiguous = model.amount_date(a, b, MatchConfig())
        assert {(r.a_id, r.b_id) for r in groups.collect()} == set(want)
        matched += len(want)
        assert {(r.entry_id, r.cand_pos, r.cand_id) for r in several.candidates().collect()} == set(ambiguous)
        assert {(r.entry_id, r.n_candidates) for r in several.counts().collect()} == set(Counter(e for e, _, _ in ambiguous).items())
    assert matched > 4


def test_a_hot_class_is_not_listed(spark):
    """A third of either side has one amount and date: edges stay as few as classes."""
    rows = lambda side: [{"book": 0, "id": f"{side}:{i}", "row_index": i, "date": datetime.date(2024, 1, 1 + i % 20 if i % 3 else 5), "description": "x", "amount": 1.0 + i % 7 if i % 3 else 2.0, "amount_abs": 1.0 + i % 7 if i % 3 else 2.0, "amount_cents": 100, "ref_number": f"r{i}"} for i in range(900)]
    a, b = frames(spark, rows("A"), rows("B"))
    groups, several = tolerance.amount_date_groups(a, b, MatchConfig())
    assert several.edges.count() < 2000 and several.scored.count() < 100
    assert several.counts().count() == 900 and several.counts().where("n_candidates >= 300").count() >= 300


@pytest.mark.parametrize("seed", [1, 2])
def test_amount_date_without_pairs_of_those_that_never_take(spark, monkeypatch, seed):
    """Dense entries, each with an amount of its own, beside a sparse chain: choices are made as by the loop, but only the chain's pairs are listed for them."""
    monkeypatch.setattr(tolerance.choices, "FEW", 0)
    rng = random.Random(seed)
    a, b = ledger(rng, "A", 60), ledger(rng, "B", 60)
    for side in (a, b):
        for i, r in enumerate(side):
            r["amount_abs"] = r["amount"] = 1000 + i / 100 if i < 40 else rng.randrange(100, 220) / 100
            r["date"] = datetime.date(2024, 1, 1) + datetime.timedelta(days=0 if i < 40 else rng.randrange(12))
    groups, several = tolerance.amount_date_groups(*frames(spark, a, b), MatchConfig())
    want, ambiguous = model.amount_date(a, b, MatchConfig())
    assert want and {(r.a_id, r.b_id) for r in groups.collect()} == set(want)
    assert {(r.entry_id, r.cand_pos, r.cand_id) for r in several.candidates().collect()} == set(ambiguous)
    assert {(r.entry_id, r.n_candidates) for r in several.counts().collect()} == set(Counter(e for e, _, _ in ambiguous).items())
    assert several.scored.where("a_row_index < 40").isEmpty()


def test_best_first_is_the_sweep(spark):
    rng = random.Random(3)
    pairs = [(0, f"A:{i}", i, f"B:{j}", j, rng.choice([0.85, 0.9, 0.95]), rng.choice([0.4, 0.5]), rng.randrange(1, 4)) for i in range(15) for j in range(15) if rng.random() < 0.4]
    frame = spark.createDataFrame(pairs, "book long, a_id string, a_row_index long, b_id string, b_row_index long, similarity double, jaccard double, place int")
    used, want = set(), set()
    for _, x, i, y, j, s, c, p in sorted(pairs, key=lambda t: (-t[5], t[2], -t[6], t[7], t[4])):
        if not {x, y} & used:
            used |= {x, y}
            want.add((x, y))
    assert {(r.a_id, r.b_id) for r in fuzzy.best_first(frame).collect()} == want


def test_splits_are_the_loop_in_each_book(spark):
    rng = random.Random(11)
    a, b = ledger(rng, "A", 25), ledger(rng, "B", 40)
    for r in a + b:
        r["amount_abs"] = r["amount"] = rng.randrange(50, 900) / 100
    cfg = MatchConfig()
    got = {(tuple(r.entries_a), tuple(r.entries_b)) for r in split.splits(*frames(spark, a, b), cfg).collect()}
    assert got == {(tuple(x), tuple(y)) for x, y in model.splits(a, b, cfg)}


@pytest.mark.parametrize(("undated", "turn"), [(False, 5000), (True, 7)])
def test_splits_of_dense_ledgers(spark, monkeypatch, undated, turn):
    """Targets that see one another's parts, in one turn or in many; and lists that run out."""
    monkeypatch.setattr(split, "TURN", turn)
    monkeypatch.setattr(split, "SPARE", 2)
    monkeypatch.setattr(split, "UNDATED", 1)
    monkeypatch.setattr(split, "TOGETHER", 0)
    rng = random.Random(12)
    a, b = ledger(rng, "A", 60), ledger(rng, "B", 120)
    for r in a + b:
        r["amount_abs"] = r["amount"] = rng.randrange(50, 900) / 100
        r["date"] = None if undated and rng.random() < 0.1 else datetime.date(2024, 1, 1) + datetime.timedelta(days=20 * rng.randrange(6) + rng.randrange(4))
    for r in a[:5]:
        r["amount_abs"] = r["amount"] = 10_000.0  # more than any five entries
    for r in [*a[6:20], *b[:60]]:  # many equal amounts of one day
        r["date"], r["amount_abs"] = datetime.date(2024, 1, 2), rng.choice([1.0, 2.0, 3.0, 5.0])
    a[5]["date"] = datetime.date(2030, 1, 1)
    cfg = MatchConfig(split_pool=10, split_max_entries=4)
    got = {(tuple(r.entries_a), tuple(r.entries_b)) for r in split.splits(*frames(spark, a, b), cfg).collect()}
    assert got == {(tuple(x), tuple(y)) for x, y in model.splits(a, b, cfg)} and len(got) > 8


def test_subset_sum():
    rng = random.Random(4)
    for _ in range(300):
        amounts = sorted((rng.choice([0.0, 0.03, 1.0, 2.5, 4.0, 9.99]) + rng.randrange(300) / 100 for _ in range(rng.randrange(0, 9))), reverse=True)
        target, tolerance, most = rng.randrange(100, 1500) / 100, rng.choice([0.0, 0.05, 0.5]), rng.randrange(2, 6)
        assert split.subset_sum(target, amounts, tolerance, most, 10**6) == model.subset(target, amounts, tolerance, most), (target, amounts, tolerance, most)
    assert split.subset_sum(10.0, [7.0, 6.0, 4.0, 3.0], 0.05, 5, 10**6) == [0, 3]
    assert split.subset_sum(10.0, [9.0, 5.0], 0.05, 5, 10**6) is None
    assert split.subset_sum(5.0, [5.0, 0.0], 0.05, 5, 10**6) == [0, 1]


def test_all_passes_on_the_derived_ledgers(spark):
    a, b = ledgers(spark, SF)
    seen = []
    result = engine.reconcile(a, b, progress=lambda n, name: seen.append(n))
    assert seen == [1, 2, 3, 4, 5]
    counts = {r.match_type: r.n_groups for r in engine.type_histogram(result.groups).collect()}
    assert counts == {"exact": 668, "amount_date": 231, "fuzzy": 225, "split": 149, "duplicate": 73, "unmatched_a": 66, "unmatched_b": 166}
    assert result.ambiguous.select("entry_id").distinct().count() == 86
    used = engine.edges(result.groups)
    assert used.count() == used.select("side", "entry_id").distinct().count() == 1350 + 1800  # every entry is in one group
    s = engine.summary(result).first()
    assert (s.matched_count, s.average_confidence) == (1273, 92)
    assert report.filter_groups(result.groups, "matched").count() == 668 + 231 + 225
    assert report.match_report(result).where("i = 0").count() == result.groups.count()
    assert report.set_status(result.groups, spark.createDataFrame([("0/1/exact/A:1", "disputed")], "group_id string, status string")).where("status = 'disputed'").count() == 1


def test_cancelled_and_empty(spark):
    a, b = frames(spark, [], [])
    assert engine.reconcile(a, b).groups.count() == 0
    rng = random.Random(1)
    a, b = frames(spark, ledger(rng, "A", 5), ledger(rng, "B", 5))
    assert engine.reconcile(a, b, cancelled=lambda: True).groups.count() == 0


def test_books_do_not_meet(spark):
    rng = random.Random(2)
    rows = ledger(rng, "A", 20, refs=(None,))
    a, b = frames(spark, rows, [{**r, "id": r["id"].replace("A", "B"), "book": 1} for r in rows])
    assert {r.match_type for r in engine.reconcile(a, b).groups.collect()} <= {"unmatched_a", "unmatched_b", "duplicate"}


def test_duplicates(spark):
    rows = [{"book": 0, "id": f"A:{i}", "row_index": i, "date": None, "description": t, "amount": 1.0, "amount_abs": 1.0, "amount_cents": 100, "ref_number": None} for i, t in enumerate(["Fee", " fee ", "x"])]
    got = residue.residue_groups(frames(spark, rows, [])[0], "A", MatchConfig()).collect()
    assert {(tuple(r.entries_a), r.match_type) for r in got} == {(("A:0", "A:1"), "duplicate"), (("A:2",), "unmatched_a")}


def test_rank_in_runs(spark):
    frame = spark.range(1000).selectExpr("id AS row_index", "IF(id % 3 = 0, NULL, id % 2) AS k")
    got = {r.row_index: r["rank"] for r in occurrence_rank(frame, ["k"], chunk=64).collect()}
    seen: dict = {}
    for i in range(1000):
        k = None if i % 3 == 0 else i % 2
        assert got[i] == seen.get(k, 0)
        seen[k] = seen.get(k, 0) + 1
