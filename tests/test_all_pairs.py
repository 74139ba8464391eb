import random

from test_passes import frames, ledger

from ledgerloom.config import MatchConfig
from ledgerloom.operators import tolerance
from ledgerloom.plans import queries

SF = "/root/testdata/sf0.001"


def test_the_query_lists_every_pair(spark):
    found = queries.amount_date_candidates(spark, SF)
    assert found.columns == ["a_id", "b_id", "diff", "days", "ref"]
    want = tolerance.candidates(*queries._left(spark, SF), MatchConfig()).collect()
    assert sorted((r.a_id, r.b_id, r["diff"], r.days, r.ref) for r in found.collect()) == sorted((r.a_id, r.b_id, round(r["diff"], 2), r.days, r.ref) for r in want) and len(want) > 20


def test_pairs_drawn_from_classes_are_all_pairs(spark):
    """Also of copies, and of entries without a date."""
    rng = random.Random(9)
    sides = ([{**r, "id": f"{r['id']}/{c}", "row_index": r["row_index"] + 1000 * c} for r in ledger(rng, name, 40) for c in range(3)] for name in "AB")
    a, b = frames(spark, *sides)
    found, want = (sorted(map(str, pairs.select(sorted(pairs.columns)).collect())) for pairs in (tolerance.class_pairs(a, b, MatchConfig()), tolerance.candidates(a, b, MatchConfig())))
    assert found == want and len(want) > 180 and any("days=-1" in r for r in want)
