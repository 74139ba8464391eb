import random

from test_passes import frames, ledger

from ledgerloom.config import MatchConfig
from ledgerloom.operators import tolerance


def test_classes_and_their_members_say_all_pairs(spark):
    """Expanding the links gives every pair with its differences; copies of entries add no links."""
    rng = random.Random(4)
    a, b = ledger(rng, "A", 40), ledger(rng, "B", 40)
    links = []
    for copies in (1, 3):
        many = [[{**r, "id": f"{r['id']}/{c}", "row_index": r["row_index"] + 1000 * c} for r in side for c in range(copies)] for side in (a, b)]
        left, right = frames(spark, *many)
        rows = tolerance.candidate_classes(left, right, MatchConfig()).collect()
        of = {kind: {} for kind in "ab"}
        for r in rows:
            if r.kind != "link":
                of[r.kind].setdefault(r.class_id, []).append(r)
        links.append([r for r in rows if r.kind == "link"])
        found = sorted((x.id, y.id, r.diff, r.days, x.ref is not None and x.ref == y.ref) for r in links[-1] for x in of["a"][r.id] for y in of["b"][r.class_id])
        want = sorted((r.a_id, r.b_id, r["diff"], r.days, r.ref) for r in tolerance.candidates(left, right, MatchConfig()).collect())
        assert found == want and len(want) > 20
        assert sum(len(x) for kind in of.values() for x in kind.values()) == 80 * copies
    assert len(links[0]) == len(links[1])
