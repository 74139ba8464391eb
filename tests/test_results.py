import pytest

from ledgerloom.config import MatchConfig
from ledgerloom.fixtures import ledgers
from ledgerloom.plans import engine, report
from ledgerloom.sources import results
from ledgerloom.streaming import micro_batch

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def result(spark):
    return engine.reconcile(*ledgers(spark, SF), MatchConfig(enabled_passes=(1, 5)))


def test_exports(spark, result, tmp_path):
    paths = results.export_all(result, str(tmp_path), "My ledger.csv", "b.csv", "2024-01-01")
    assert paths[0].endswith("reconciliation_My_ledger_vs_b_2024-01-01_full")
    assert spark.read.csv(paths[1], header=True).count() == report.unmatched_report(result).count()
    assert results.read_documents(spark, paths[-1]).count() == result.groups.count()
    spark.range(1).selectExpr("'{\"metadata\": {\"format\": \"x\"}}' AS value").write.text(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="not a reconciliation document"):
        results.read_documents(spark, str(tmp_path / "bad")).collect()
    results.write_result(result, str(tmp_path / "kept"))
    assert results.read_result(spark, str(tmp_path / "kept"), result.config).groups.count() == result.groups.count()


def test_changes(spark, result):
    changed = report.apply_overrides(result.ledger_a.selectExpr("*", "CAST(NULL AS DOUBLE) AS debit", "CAST(NULL AS DOUBLE) AS credit", "CAST(NULL AS DOUBLE) AS balance"), spark.createDataFrame([("A:1", 5.0)], "id string, credit double"))
    assert changed.where("id = 'A:1'").first().amount == 5.0 and changed.where("id = 'A:2'").first().amount < 0
    found = report.sort_groups(report.filter_groups(result.groups, "all", "exact MATCH"), "confidence")
    assert report.page(found, 2, 3).count() == 3
    assert {r.different for r in report.field_differences(result).where("field = 'date'").collect()} == {False}
    comments = spark.createDataFrame([], "group_id string, text string, created_by string, created_at long")
    assert report.add_comments(comments, spark.createDataFrame([("g", "b", "x", 2), ("g", "a", "x", 1)], comments.schema)).orderBy("pos").first().text == "a"
    result.register("r_")
    assert spark.sql("SELECT count(*) FROM r_groups").first()[0] == result.groups.count()


def test_streams(spark, tmp_path):
    a, b = ledgers(spark, SF)
    rows = a.selectExpr("*", "'A' AS party").unionByName(b.selectExpr("*", "'B' AS party"))
    rows.coalesce(2).write.parquet(str(tmp_path / "in"))
    seen = []
    query = micro_batch.reconcile_batches(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), lambda r, n: seen.append(r.groups.count()), MatchConfig(enabled_passes=(1, 5)), str(tmp_path / "check"))
    query.awaitTermination(300)
    assert seen == [engine.reconcile(a, b, MatchConfig(enabled_passes=(1, 5))).groups.count()]


def test_exact_stream(spark, tmp_path):
    a, b = ledgers(spark, SF)
    for name, side in (("a", a), ("b", b)):
        side.selectExpr("*", "TIMESTAMP '2024-01-01 00:00:00' AS arrived").write.parquet(str(tmp_path / name))
    read = lambda n: spark.readStream.schema(spark.read.parquet(str(tmp_path / n)).schema).parquet(str(tmp_path / n))
    query = micro_batch.exact_stream(read("a"), read("b")).writeStream.format("memory").queryName("exact_pairs").trigger(availableNow=True).start()
    query.awaitTermination(300)
    assert spark.sql("SELECT count(*) FROM exact_pairs").first()[0] >= 668


def test_one_ordered_csv_file(spark, tmp_path):
    rows = [(i, 'say "hi", ' + "é" * (i % 3) if i % 4 else None, i / 2) for i in range(500)]
    frame = spark.createDataFrame(rows, "id long, text string, x double").repartition(7)
    line = lambda r: ",".join('"' + ("" if v is None else str(v)).replace('"', '""') + '"' for v in r)
    want = "\r\n".join(line(r) for r in [("id", "text", "x"), *rows]).encode()
    for bom in (False, True):
        results.write_csv_file(frame, f"file://{tmp_path}/one.csv", ["id"], bom=bom)
        assert (tmp_path / "one.csv").read_bytes() == (b"\xef\xbb\xbf" if bom else b"") + want
    results.write_csv_file(frame.limit(0), f"file://{tmp_path}/none.csv", ["id"], bom=True)
    assert (tmp_path / "none.csv").read_bytes() == b""
    results.write_csv_file(frame.where("id < 1"), f"file://{tmp_path}/tab.csv", ["id"], separator="\t")
    assert (tmp_path / "tab.csv").read_bytes() == b'"id"\t"text"\t"x"\r\n"0"\t""\t"0.0"'


def test_pages_by_place(spark, result):
    for by, descending in (("amount", True), ("confidence", False), ("type", True)):
        want = [r.group_id for r in report.sort_groups(result.groups, by, descending).limit(130).collect()]
        got, last = [], None
        for _ in range(3):
            rows = report.page_after(result.groups, by, descending, last, 40).collect()
            got, last = got + [r.group_id for r in rows], rows[-1]
        assert got == want[:120]
    nulls = spark.createDataFrame([(1, "a", None), (1, "b", 2.0), (2, "c", None), (2, "d", 1.0)], "pass_number int, group_id string, amount_difference double")
    for descending, order in ((True, "bdac"), (False, "acdb")):
        got, last = "", None
        for _ in range(4):
            last = report.page_after(nulls, "amount", descending, last, 1).first()
            got += last.group_id
        assert got == order and report.page_after(nulls, "amount", descending, last, 1).first() is None
    with pytest.raises(ValueError, match="cannot be sorted by date"):
        report.sort_groups(result.groups, "date")


def test_polarity_of_each_book(spark):
    a, b = ledgers(spark, SF, books=2)
    turned = a.selectExpr("* EXCEPT (amount)", "IF(book = 1, -amount, amount) AS amount")
    assert {r.book: r.polarity for r in engine.polarity_by_book(turned, b).collect()} == {0: "opposite_sign", 1: "same_sign"}
    assert engine.detect_polarity(turned, b) == "absolute" and engine.detect_polarity(a, b) == "opposite_sign"
