import random

from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.fixtures import event_ledgers
from ledgerloom.functions import text as X
from ledgerloom.operators import fuzzy

SF = "/root/testdata/sf0.001"


def test_short_lists_of_pairs_give_the_outcome_of_one_sweep(spark, monkeypatch):
    """Each entry lists its best pair alone, and equal entries all list the same one: what hangs on pairs that are not listed waits for the next phase."""
    a, b = (side.withColumn("description", F.when(F.col("row_index") % 5 < 2, "click user 235").otherwise(F.col("description"))).withColumn("amount_abs", F.round(F.col("amount_abs"))) for side in event_ledgers(spark, SF))
    found, phases, similar = [], [], fuzzy._similar

    def seen(*args):
        made = similar(*args)
        phases.append(made.count())
        return made

    monkeypatch.setattr(fuzzy, "_similar", seen)
    for small, most, equals in ((10**9, 12, 48), (0, 1, 0)):
        monkeypatch.setattr(fuzzy, "SMALL", small)
        monkeypatch.setattr(fuzzy, "MOST", most)
        monkeypatch.setattr(fuzzy, "EQUALS", equals)
        found.append({(r.a_id, r.b_id, r.similarity) for r in fuzzy.chosen_pairs(a, b, MatchConfig()).collect()})
    assert found[0] == found[1] and len(found[0]) > 20
    assert len(phases) > 3 and max(phases[2:]) * 2 < phases[0]


def test_words_within_a_task_are_those_of_the_column(spark):
    rng = random.Random(7)
    words = ["order", "customer", "custom", "low", "pmt", "part"]
    word = lambda: rng.choice(words) if rng.random() < 0.4 else str(rng.randrange(10 ** rng.randrange(1, 10)))
    rows = [(" ".join(word() for _ in range(rng.randrange(1, 7))), " ".join(word() for _ in range(rng.randrange(1, 7)))) for _ in range(3000)] + [("479", "179"), ("a", "b")]
    p, q = F.col("p"), F.col("q")
    frame = spark.createDataFrame(rows, "p string, q string").select("p", "q", X.token_containment(p, q).alias("found"), X.jaro_winkler_ci(p, q).alias("jaro"))
    for r in frame.collect():
        given = list(dict.fromkeys(r.q.split()))
        assert X.contained([t for t in r.p.split() if len(t) >= 2], r.q, given) == r.found and X.winkler(r.p, r.q) == r.jaro
