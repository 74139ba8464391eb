import datetime

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig, Weights
from ledgerloom.functions import amounts, dates, scoring
from ledgerloom.functions import text as X
from ledgerloom.operators import similar
from ledgerloom.sources import csv_ledger, lines

AMOUNTS = [
    ("(5,000.00)", -5000.0), ("5000 DR", -5000.0), ("5000-", -5000.0), ("-$50.00", -50.0), ("$1,234.50 CR", 1234.5), ("(50.00) CR", -50.0), ("1.234,56", 1234.56), ("1,23,456.78", 123456.78), ("1,234", 1234.0),
    ("1.234", 1.234), ("1,23", 1.23), ("1.234.567", 1234567.0), ("12abc", 12.0), ("0.00", 0.0), ("CREDIT", None), ("N/A", None), ("", None), (None, None),
]
DATES = [
    ("15/01/2024", None, "2024-01-15"), ("01/15/2024", None, "2024-01-15"), ("03/04/2024", None, "2024-04-03"), ("03/04/2024", "MM/DD/YYYY", "2024-03-04"), ("2024-1-5", None, "2024-01-05"), ("15-Jan-24", None, "2024-01-15"),
    ("15 January 2024", None, "2024-01-15"), ("Jan 15, 2024", None, "2024-01-15"), ("15/01/49", None, "2049-01-15"), ("15/01/50", None, "1950-01-15"), ("20240115", None, "2024-01-15"), ("31/02/2024", None, None),
]
ALIKE = [
    ("Payment to Acme Widget Supply Co Invoice 1042", "ACH DEBIT ACME WIDGET SUP 1042", 0.697531, 0.488889, 0.272727, 0.45, 0.560679, 17), ("Widget Supply Co Invoice 1042", "Invoice 1042 - Widget Supply", 0.499813, 0.896552, 0.8, 0.8, 0.708891, 21),
    ("MARTHA", "MARHTA", 0.961111, 0.666667, 0, 0, 0.584444, 1), ("Rent March", "RENT MARCH", 1, 1, 1, 1, 1, 8), ("abcdef", "abxyzwq", 0.631746, 0.285714, 0, 0, 0.338413, 0), ("Office supplies", "Ofice suplies", 0.964444, 0.866667, 0, 0.427083, 0.773903, 9),
]


def test_amounts(spark):
    got = spark.createDataFrame([(x,) for x, _ in AMOUNTS], "r string").select(amounts.parse_amount(F.col("r"))["value"].alias("v")).collect()
    assert [r.v for r in got] == [v for _, v in AMOUNTS]


def test_amounts_in_text(spark):
    row = spark.sql("SELECT 'paid $1,234.50 and (20.00) DR' AS t").select(amounts.amounts_in_text(F.col("t"))["value"].alias("v")).first()
    assert row.v == [1234.5, -20.0]


@pytest.mark.parametrize(("raw", "preferred", "iso"), DATES)
def test_dates(spark, raw, preferred, iso):
    row = spark.createDataFrame([(raw,)], "r string").select(dates.parse_date(F.col("r"), preferred)["date"].alias("d")).first()
    assert row.d == (datetime.date.fromisoformat(iso) if iso else None)


def test_similarities(spark):
    frame = spark.createDataFrame([(x[0], x[1]) for x in ALIKE], "a string, b string")
    a, b = F.col("a"), F.col("b")
    got = frame.select(X.jaro_winkler_ci(a, b), X.token_sort_ratio(a, b), X.token_set_ratio(a, b), X.token_containment(a, b), X.description_similarity(a, b, Weights()), F.size(F.array_intersect(X.ngrams(a), X.ngrams(b)))).collect()
    for row, want in zip(got, ALIKE, strict=True):
        assert [round(x, 6) for x in row] == pytest.approx(want[2:], abs=2e-6)


def test_scores(spark):
    row = spark.range(1).select(
        scoring.confidence_amount_date(F.lit(2), F.lit(0.03), F.lit(100.0), F.lit(False)), scoring.confidence_fuzzy(F.lit(0.9), F.lit(0), F.lit(0.0), F.lit(5.0), F.lit(True)), scoring.money(F.lit(1234.005)),
        scoring.refs_match(F.lit("ORD-1"), F.lit("ord1")), scoring.refs_match(F.lit("--"), F.lit("--")), scoring.dates_match(F.lit(None).cast("date"), F.current_date(), 0),
    ).first()
    assert list(row) == [89, 100, "1234.01", True, False, True]


def test_config():
    with pytest.raises(ValueError):
        MatchConfig(amount_tolerance_mode="x")
    assert MatchConfig().toggle_pass(3).enabled_passes == (1, 2, 4, 5)


@pytest.mark.parametrize(("header", "role"), [("Value Date", "date"), ("Particulars", "description"), ("Withdrawal", "debit"), ("Paid In", "credit"), ("Sum", "amount"), ("Running Balance", "balance"), ("Cheque No", "reference"), ("Address", "debit"), ("Foo", "unknown")])
def test_roles(header, role):
    assert csv_ledger.role_of(header) == role


def test_csv_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('My bank\n\nDate,Narration,Cheque No,Withdrawal,Deposit,Balance\n15/01/2024,"Rent, March",ORD-1,"1,200.50",,500.00\n16/01/2024,Salary,,,"3,000.00","3,500.00"\n,,,,,\n')
    (tmp_path / "b.csv").write_text("2024-01-15;Rent;-1.200,50\n2024-01-16;Pay;3.000,00\n")
    (tmp_path / "c.csv").write_text("Date,Description,Debit\n2024-01-15,Fee,5.00\n2024-01-16,Fee,6.00\n")
    (tmp_path / "d.csv").write_text("one row\n")
    book = "ascii(regexp_extract(path, '(.)[.]csv', 1))"
    rows = csv_ledger.read_ledger(spark, f"{tmp_path}/*.csv", "A", book).collect()
    got = sorted((chr(r.book), r.row_index, str(r.date), r.description, r.debit, r.credit, r.balance, r.ref_number) for r in rows)
    assert got == [
        ("a", 0, "2024-01-15", "Rent, March", 1200.5, None, 500.0, "ORD-1"), ("a", 1, "2024-01-16", "Salary", None, 3000.0, 3500.0, None), ("b", 3, "2024-01-15", "Rent", 1200.5, None, None, None),
        ("b", 4, "2024-01-16", "Pay", None, 3000.0, None, None), ("c", 5, "2024-01-15", "Fee", 5.0, None, None, None), ("c", 6, "2024-01-16", "Fee", 6.0, None, None, None),
    ]
    lost = csv_ledger.read_ledger(spark, f"{tmp_path}/c.csv", "A", lone_side=False).collect()
    assert [r.debit for r in lost] == [None, None]


def test_lines(spark):
    box = lambda x: {"x0": x, "y0": 0.0, "x1": x + 40, "y1": 10.0}
    word = lambda t, x: {"text": t, "confidence": 90.0, "bbox": box(x)}
    texts = [
        (1, "Date Description Debit Credit", []), (1, "01/02/2024 Rent 50.00", [word("01/02/2024", 0.0), word("Rent", 100.0), word("50.00", 200.0)]), (1, "to landlord", [word("to", 100.0), word("landlord", 145.0)]), (1, "Page 1 of 2", []),
        (2, "Date Description Debit Credit", []), (2, "02/02/2024 Pay 70.00", [word("02/02/2024", 0.0), word("Pay", 100.0), word("70.00", 300.0)]), (2, "02/02/2024 Pay 70.00", []), (2, "Grand Total 120.00", []), (2, "", []),
    ]
    from ledgerloom.schema import LINES

    frame = spark.createDataFrame([("d", p, i, t, 90.0, box(0.0), w) for i, (p, t, w) in enumerate(texts)], LINES)
    kept, removed = lines.merge_pages(frame)
    assert {(r.line_index, r.reason) for r in removed.collect()} == {(3, "page_footer"), (4, "repeated_header"), (6, "duplicate_boundary"), (7, "subtotal"), (8, "empty")}
    classified = lines.classify(kept)
    assert [r.kind for r in classified.orderBy("line_index").collect()] == ["header", "data", "continuation", "data"]
    columns = [("date", 0, 60), ("description", 90, 190), ("debit", 195, 260), ("credit", 290, 360)]
    got = lines.parse_lines(classified, columns, "A").orderBy("row_index").collect()
    assert [(str(r.date), r.description, r.debit, r.credit) for r in got] == [("2024-02-01", "Rent to landlord", 50.0, None), ("2024-02-02", "Pay", None, 70.0)]


def test_keys(spark):
    from ledgerloom.functions import keys

    row = spark.range(1).select(keys.fnv1a(F.lit("hello")), keys.fnv1a(F.lit("")), keys.amount_to_cents(F.lit(-2.5)), keys.match_key(F.lit(None).cast("date"), F.lit(-1.5), F.lit("A-1")), keys.sha256(F.lit("a"))).first()
    assert list(row) == ["4f9f2cab", "811c9dc5", -250, "0000-00-00|150|a1", "ca978112ca1bbdcafac231b39a23dc4da786eff8147c4e72b9807785afee48bb"]


def test_best_matches(spark):
    queries = spark.createDataFrame([(1, "rent march")], "id long, text string")
    targets = spark.createDataFrame([(1, "Rent March"), (2, "rent marsh"), (3, "zzz"), (4, "rent march x")], "id long, text string")
    assert [r.target_id for r in similar.best_matches(queries, targets, 2).orderBy("rank").collect()] == [1, 4]


def test_columns_of_lines(spark):
    from ledgerloom.schema import LINES

    box = lambda x: {"x0": float(x), "y0": 0.0, "x1": x + 40.0, "y1": 10.0}
    word = lambda t, x: {"text": t, "confidence": 90.0, "bbox": box(x)}
    rows = [("d", 1, 0, "Date Particulars Debit", 90.0, box(0), [word("Date", 0), word("Particulars", 100), word("Debit", 300)]), ("e", 1, 0, "x", 90.0, box(0), [word("x", 60)])]
    got = {(r.doc, r.role, r.x_start, r.confidence) for r in lines.detect_columns(spark.createDataFrame(rows, LINES)).collect()}
    assert {("d", "date", 0.0, 0.9), ("d", "description", 100.0, 0.9), ("d", "debit", 300.0, 0.9), ("e", "description", 15.0, 0.3)} <= got and len(got) == 8


def test_clean_text(spark):
    row = spark.range(1).select(lines.clean_ocr_text(F.lit("| 1l2  4O5 “a” ")), csv_ledger.ledger_summary is not None and F.lit(1)).first()
    assert row[0] == '112 405 "a"'


def test_totals_do_not_pile_up_errors(spark):
    from ledgerloom.sources.csv_ledger import ledger_summary

    rows = spark.range(100_000).selectExpr("0L AS book", "'A' AS party", "CAST(NULL AS DATE) AS date", "0.1D AS debit", "IF(id = 7, 1e11D, 0.01D) AS credit", "90D AS ocr_confidence")
    got = ledger_summary(rows).first()
    assert (got.total_debit, got.total_credit) == (10_000.0, 100_000_000_999.99)
    huge = ledger_summary(rows.selectExpr("* EXCEPT (debit)", "1e300D AS debit")).first()
    assert huge.total_debit == pytest.approx(1e305)
