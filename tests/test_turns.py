import re

from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.fixtures import event_ledgers, ledgers
from ledgerloom.functions import text as X
from ledgerloom.operators import fuzzy

SF = "/root/testdata/sf0.001"


def test_turns_take_the_pairs_of_one_sweep_and_form_fewer(spark, monkeypatch):
    formed, write = [], fuzzy.materialize

    def counted(frame, label):
        made = write(frame, label)
        if label == "fuzzy-candidates":
            formed.append(made.count())
        return made

    monkeypatch.setattr(fuzzy, "materialize", counted)
    for a, b in (ledgers(spark, SF), event_ledgers(spark, SF)):
        found, many = [], []
        for small in (10**9, 0):
            monkeypatch.setattr(fuzzy, "SMALL", small)
            formed.clear()
            found.append({(r.a_id, r.b_id, r.similarity) for r in fuzzy.chosen_pairs(a, b, MatchConfig()).collect()})
            many.append(formed[-1])  # of the last turn
        assert found[0] == found[1] and len(found[0]) > 20
        assert many[1] < many[0]


def test_ngrams_normalize_a_text_once(spark):
    plan = spark.range(1).select(X.ngrams(F.col("id").cast("string")).alias("g"))._jdf.queryExecution().analyzed().toString()
    assert len(re.findall("regexp_replace\\(", plan)) == 2  # one of either kind, outside of the n-grams' lambda
    rows = spark.sql("SELECT '' AS a UNION ALL SELECT 'ab' UNION ALL SELECT 'A-b c d'").select(X.ngrams(F.col("a")).alias("g")).collect()
    assert sorted(r.g for r in rows) == [[], ["ab"], ["ab ", "b c", " c ", "c d"]]
