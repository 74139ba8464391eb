import threading
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig
from ledgerloom.fixtures import ledgers
from ledgerloom.operators import fuzzy
from ledgerloom.plans import engine

SF = "/root/testdata/sf0.001"


def slow(spark, seconds):
    """A job that would take so long."""

    def wait(batches):
        time.sleep(seconds)
        yield from batches

    return spark.range(4, numPartitions=4).mapInPandas(wait, "id long")


def test_a_running_pass_is_cancelled(spark, monkeypatch):
    """Pass 3 would take a minute; it ends soon after it is asked to, and what passes 1 and 2 found is there."""
    a, b = ledgers(spark, SF)
    config = MatchConfig(enabled_passes=(1, 2, 3, 5))
    asked, seen = threading.Event(), []

    def hang(left, right, config):
        threading.Timer(1.5, asked.set).start()
        slow(spark, 60).count()
        raise AssertionError("not cancelled")

    monkeypatch.setattr(fuzzy, "fuzzy_groups", hang)
    starts = {}
    result = engine.reconcile(a, b, config, lambda n, _: starts.setdefault(n, time.time()), asked.is_set, lambda n, done, whole: seen.append((n, done, whole)))
    assert time.time() - starts[3] < 20 and 5 not in starts
    assert {r.pass_number for r in result.groups.select("pass_number").distinct().collect()} == {1, 2}
    want = engine.reconcile(a, b, MatchConfig(enabled_passes=(1, 2)))
    assert result.groups.count() == want.groups.count() and result.ambiguous.count() == want.ambiguous.count()
    assert all(0 <= done <= whole for _, done, whole in seen) and {n for n, _, _ in seen} >= {3}
    assert spark.range(10).count() == 10 and not [t for t in spark.sparkContext.getJobTags() if t.startswith("pass-")]


def test_only_jobs_within_are_cancelled(spark):
    """Work of another thread goes on, a failure that nobody asked for is itself, and an error of a callback is raised."""
    out = []
    other = threading.Thread(target=lambda: out.append(slow(spark, 4).count()))
    with pytest.raises(engine.Cancelled), engine.watched(spark, "x", lambda: bool(other.is_alive() or other.start()), every=0.2):
        slow(spark, 30).count()
    other.join()
    assert out == [4]
    with pytest.raises(Exception, match="on purpose") as told, engine.watched(spark, "x", lambda: False):
        spark.range(1).select(F.raise_error(F.lit("on purpose"))).collect()
    assert not isinstance(told.value, engine.Cancelled)
    with pytest.raises(KeyError, match="callback"), engine.watched(spark, "x", tasks=lambda done, whole: {}["callback"], every=0.1):
        slow(spark, 20).count()
