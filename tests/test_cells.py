"""What decides within a cell of pass 3 which pairs are scored one by one, against plain functions."""

import random

import numpy as np
import pyarrow as pa

from ledgerloom.config import MatchConfig
from ledgerloom.functions import bounds
from ledgerloom.functions import text as X
from ledgerloom.operators import fuzzy

WORDS = ["order", "customer", "custom", "low", "pmt", "part", "1", "5", "not", "specified"]


def _texts(rng: random.Random, many: int) -> list[str]:
    word = lambda: rng.choice(WORDS) if rng.random() < 0.5 else str(rng.randrange(10 ** rng.randrange(1, 11)))
    return [" ".join(word() for _ in range(rng.randrange(1, 9))) for _ in range(many)]


def test_jaro_winkler_of_many_pairs_is_that_of_each():
    rng = random.Random(3)
    texts = [t[:64] for t in _texts(rng, 60)] + ["a", "é-é x", "ABBA-abba", "x" * 64, "ab" * 32, "über 12 ß"]
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    assert bounds.winklers(texts, texts, i, j).tolist() == [X.winkler(texts[p], texts[q]) for p, q in zip(i, j, strict=True)]


def test_words_bound_containment():
    rng = random.Random(8)
    texts = _texts(rng, 90) + ["", " ".join(str(k) for k in range(60))]
    asked, given = [[w for w in t.split() if len(w) >= 2] for t in texts], [list(dict.fromkeys(t.split())) for t in texts]
    i, j = (v.ravel() for v in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    x, y = bounds.words_of(asked, bounds.WORDS), bounds.words_of(given, bounds.GIVEN)
    exact = np.array([X.contained(asked[p], texts[q], given[q]) for p, q in zip(i, j, strict=True)])
    loose, some, closer = bounds.containment(x, y, i, j), bounds.found(x, y, i, j, False), bounds.found(x, y, i, j, True)
    for bound in (loose, some, closer):
        assert (bound >= exact - 1e-12).all()
    assert 2 * (closer - exact).mean() < (loose - exact).mean()


def test_few_pairs_are_scored_one_by_one():
    """Descriptions of one pattern with different numbers: nearly all pairs that are left have a similarity of the threshold."""
    rng = random.Random(6)
    low = [f"order {rng.randrange(900000)} customer {rng.randrange(90000)} {rng.choice(['1-urgent', '2-high', '5-low'])}" for _ in range(400)]
    low += [f"order {'7' * 40} customer {'1' * 30}", "x" * 300, "part 1 of 2"]
    text = [t.replace("-", " ") for t in low]
    table = pa.table({"low": low, "text": text, "sorted": [" ".join(sorted(t.split())) for t in text], "flat": [t.replace("-", "") for t in low], "amount_abs": [1000 + rng.random() * 3 for _ in low], "row_index": range(len(low))})
    for threshold in (0.82, 0.7):
        i, j, winkler, unlike, _ = fuzzy._reachable(MatchConfig(), threshold)(table, table)
        score = fuzzy._exact(table, table, MatchConfig(), threshold)
        found = {(p, q) for p, q, *known in zip(i.tolist(), j.tolist(), winkler.tolist(), unlike.tolist(), strict=True) if score(p, q, *known)[0] >= 0}
        amounts = table["amount_abs"].to_pylist()
        near = [(p, q) for p in range(len(low)) for q in range(len(low)) if abs(amounts[p] - amounts[q]) <= max(amounts[p], amounts[q]) * 0.001]
        want = {(p, q) for p, q in near if score(p, q, 1.0, X.distance(table["sorted"][p].as_py(), table["sorted"][q].as_py()))[0] >= 0}
        assert found == want and len(want) > len(low) and len(near) > 20_000
        assert len(i) < 1.5 * len(want)
