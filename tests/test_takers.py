import random

import pytest
from pyspark.sql import functions as F
from test_passes import frames, ledger

from ledgerloom.config import MatchConfig
from ledgerloom.operators import settle, tolerance


@pytest.mark.parametrize("listed", [1, 16])
def test_takers_are_those_of_all_edges(spark, monkeypatch, listed):
    """Over blocks of amounts, and for classes that see more than are listed; edges of these are not written."""
    rng = random.Random(2)
    sides = ([r | {"amount_abs": 100 + rng.random() * (4 if r["row_index"] < 40 else 20)} for r in ledger(rng, name, 120)] for name in "AB")
    a, b = (tolerance.classes(side) for side in frames(spark, *sides))
    edges = [(r.a_id, r.b_id, r.b_n) for r in tolerance._edges(a, b, MatchConfig()).select("a_id", "b_id", "b_n").collect()]
    seen = {}
    for x, y, n in edges:
        seen.setdefault(x, {})[y] = n
    want, gone, before = set(), set(), None
    while before != len(want):
        before = len(want)
        want |= {x for x, of in seen.items() if max(of.values()) == 1 and len(of.keys() - gone) <= 1}
        gone |= {y for x in want for y in seen[x]}
    written, write = [], tolerance.materialize

    def counted(frame, label):
        made = write(frame, label)
        if label == "class-edges":
            written.append(made.groupBy("a_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0)
        return made

    monkeypatch.setattr(settle, "FEW", 0)
    monkeypatch.setattr(tolerance, "LISTED", listed)
    monkeypatch.setattr(tolerance, "NEXT", 3)
    monkeypatch.setattr(tolerance, "materialize", counted)
    found = tolerance.takers(tolerance.degrees(a, b, MatchConfig()), b, MatchConfig())
    assert {r.a_id for r in found.collect()} == want and 3 < len(want) < len(seen)
    assert written[0] <= listed
