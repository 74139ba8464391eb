import random

import pytest

from ledgerloom.config import MatchConfig
from ledgerloom.fixtures import ledgers
from ledgerloom.plans import engine
from ledgerloom.sources.changes import ChangeLog

SF = "/root/testdata/sf0.001"


def replay(batches):
    """Statuses and overrides by a plain loop over all changes in order."""
    statuses, edits = {}, {}
    for at, seq, kind, key, field, value in sorted(batches):
        if kind == "status":
            statuses[key] = value
        else:
            edits.setdefault(key, {})[field] = value
    return statuses, edits


def seen(log):
    statuses = {r.group_id: r.status for r in log.statuses().collect()}
    edits = {r.id: {c: r[c] for c in ("description", "credit") if r[c] is not None} for r in log.overrides().collect()}
    return statuses, edits


def test_any_order_of_appends_equals_a_replay(spark, tmp_path):
    dice = random.Random(5)
    every = []
    for i in range(60):
        kind = dice.choice(["status", "edit"])
        key = f"k{dice.randrange(6)}"
        field = "" if kind == "status" else dice.choice(["description", "credit"])
        value = dice.choice(["open", "resolved", "disputed", "ignored"]) if kind == "status" else (float(i) if field == "credit" else f"text {i}")
        every.append((1_700_000_000 + dice.randrange(8), i, kind, key, field, value))  # many of one instant, told apart by seq
    for turn in range(2):
        dice.shuffle(every)
        log, other = ChangeLog(spark, str(tmp_path / f"log{turn}")), ChangeLog(spark, str(tmp_path / f"log{turn}"))
        assert log.live() == [] and log.state().count() == 0
        for start in range(0, 60, 20):
            part = every[start : start + 20]
            status = [(x[3], x[5], x[0], x[1]) for x in part if x[2] == "status"]
            log.set_status(spark.createDataFrame(status, "group_id string, status string, at long, seq long").selectExpr("* EXCEPT (at)", "timestamp_seconds(at) AS at"))
            edits = [(x[3], x[5] if x[4] == "description" else None, x[5] if x[4] == "credit" else None, x[0], x[1]) for x in part if x[2] == "edit"]
            other.edit(spark.createDataFrame(edits, "id string, description string, credit double, at long, seq long").selectExpr("* EXCEPT (at)", "timestamp_seconds(at) AS at"))
            if start == 20:
                log.compact()
        want = replay(every)
        assert seen(log) == want
        before = log.live()
        first = log.compact()
        assert log.live() == [first] and log.compact() is None and seen(other) == want
        # A second compaction that began with the same pieces: both are live, and the state is the same.
        second = other._write(spark.read.parquet(*[f"{log.path}/{n}/rows" for n in before]), before, "state-late")
        assert set(log.live()) == {first, second} and seen(log) == want
        assert log.vacuum() > 0 and seen(log) == want and log.vacuum() == 0


def test_writers_lose_nothing_and_unfinished_pieces_do_not_count(spark, tmp_path):
    one, two = ChangeLog(spark, str(tmp_path / "log")), ChangeLog(spark, str(tmp_path / "log"))
    rows = lambda text: spark.createDataFrame([("g", text, 1), ("g", text, 1)], "group_id string, text string, seq long").selectExpr("*", "timestamp_seconds(9) AS at")
    one.comment(rows("a"))
    base = one.live()
    two.comment(rows("b"))  # while the first is compacted
    one._write(one.spark.read.parquet(f"{one.path}/{base[0]}/rows"), base, "state-1")
    assert sorted(r.text for r in one.comments().collect()) == ["a", "a", "b", "b"]  # equal comments are two
    one.compact()
    assert sorted(r.text for r in two.comments().collect()) == ["a", "a", "b", "b"]
    rows("c").write.parquet(f"{one.path}/batch-broken/rows")
    assert one.comments().count() == 4
    with pytest.raises(Exception, match="no such status: done"):
        one.set_status(spark.createDataFrame([("g", "done")], "group_id string, status string"))
    with pytest.raises(Exception, match="has no key"):
        one.set_status(spark.createDataFrame([(None, "open")], "group_id string, status string"))
    with pytest.raises(ValueError, match="an edit sets one of"):
        one.edit(spark.createDataFrame([("A:1",)], "id string"))
    assert one.comments().count() == 4 and one.statuses().count() == 0


def test_changes_of_a_result(spark, tmp_path):
    result = engine.reconcile(*ledgers(spark, SF), MatchConfig(enabled_passes=(1, 2)))
    log = ChangeLog(spark, str(tmp_path / "log"))
    group = result.groups.orderBy("group_id").first()
    entry = group.entries_a[0]
    log.edit(spark.createDataFrame([(entry, 12.5, None), ("none", 1.0, "x")], "id string, credit double, description string"))
    log.edit(spark.createDataFrame([(entry, "by hand")], "id string, description string"))
    log.set_status(spark.createDataFrame([(group.group_id, "disputed")], "group_id string, status string"))
    log.record_run(result, "run-1")
    log.record_run(result, "run-2")
    after = log.apply(result)
    assert [(r.description, r.amount, r.amount_cents) for r in after.ledger_a.where(f"id = '{entry}'").collect()] == [("by hand", 12.5, 1250)]
    assert after.ledger_a.count() == result.ledger_a.count() and after.groups.count() == result.groups.count()
    assert [r.group_id for r in after.groups.where("status <> 'open'").collect()] == [group.group_id]
    assert [r.run_id for r in log.runs().collect()] == ["run-2", "run-1"] and log.runs(1).first().run_id == "run-2"
    unclear = result.ambiguous_counts.first()
    if unclear is not None:
        log.resolve(spark.createDataFrame([(unclear.entry_id,)], "entry_id string"))
        assert log.apply(result).ambiguous_counts.count() == result.ambiguous_counts.count() - 1
