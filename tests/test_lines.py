from pyspark.sql import functions as F

from ledgerloom.functions import amounts
from ledgerloom.schema import LINES
from ledgerloom.sources import lines


def box(x, width=40.0):
    return {"x0": float(x), "y0": 0.0, "x1": x + width, "y1": 10.0}


def word(text, x, width=40.0):
    return {"text": text, "confidence": 90.0, "bbox": box(x, width)}


def statement(doc, rows):
    return [(doc, 1, i, " ".join(w["text"] for w in words), 90.0, box(0), words) for i, words in enumerate(rows)]


def zones_by_loop(rows, gap=0.05):
    """Zones of one document as a loop over its sorted words, without roles."""
    width = max(w["bbox"]["x1"] for words in rows for w in words)
    xs = sorted(w["bbox"]["x0"] for words in rows[3:20] for w in words)
    found = [[xs[0], xs[0]]]
    for x in xs[1:]:
        if x - found[-1][1] > width * gap:
            found.append([x, x])
        found[-1][1] = x
    return [tuple(z) for z in found]


def test_zones_and_ledger_without_header(spark):
    rows = [[word(f"2024-01-{i + 1:02}", 10 + i % 3), word("Grocer", 120), word("market", 170), word(f"{'-' if i % 2 else ''}1,{i:03}.50", 400 + i % 4)] for i in range(12)]
    frame = spark.createDataFrame(statement("d", rows) + statement("few", rows[:4]), LINES)
    got = lines.zones(frame).where("doc = 'd'").orderBy("zone").collect()
    assert [(z.x_start, z.x_end) for z in got] == zones_by_loop(rows)
    assert [(z.role, z.confidence) for z in got] == [("date", 1.0), ("description", 1.0), ("description", 1.0), ("amount", 1.0)]
    assert {r.doc for r in lines.zones(frame).collect()} == {"d"}  # the other has one line after the third
    entries = lines.read_lines(frame, "A").where("doc = 'd'").orderBy("row_index").collect()
    assert [(str(e.date), e.description, e.amount_cents) for e in entries] == [(f"2024-01-{i + 1:02}", "market", (-1 if i % 2 else 1) * (100050 + i * 100)) for i in range(12)]


def test_header_comes_before_content(spark):
    head = [word("Date", 10), word("Particulars", 120), word("Debit", 300), word("Credit", 400)]
    rows = [head] + [[word(f"{i + 13}/01/2024", 10), word("Rent", 120), word("5,50", 300 if i % 2 else 400)] for i in range(8)]
    entries = lines.read_lines(spark.createDataFrame(statement("d", rows), LINES), "B").orderBy("row_index").collect()
    assert [(str(e.date), e.debit, e.credit) for e in entries] == [(f"2024-01-{i + 13}", 5.5 if i % 2 else None, None if i % 2 else 5.5) for i in range(8)]


def test_no_lines(spark):
    empty = spark.createDataFrame([], LINES)
    assert lines.read_lines(empty, "A").count() == 0 and lines.zones(empty).count() == 0


def test_formats_of_each_document(spark):
    """European numbers in one document, American ones in another."""
    one = lambda t: [[word(f"{i + 13}.01.2024", 10), word("Miete", 120), word(t, 400)] for i in range(8)]
    frame = spark.createDataFrame(statement("eu", one("1.234,50")) + statement("us", one("1,234.50")), LINES)
    assert {(e.doc, e.amount_cents) for e in lines.read_lines(frame, "A").collect()} == {("eu", 123450), ("us", 123450)}


def test_currency_symbol(spark):
    rows = [("a", "£5"), ("a", "£6"), ("a", "$7"), ("b", "8"), ("b", None), ("c", "$1"), ("c", "€1"), ("d", "5 kr")]
    got = spark.createDataFrame(rows, "k string, t string").groupBy("k").agg(amounts.currency_symbol(F.col("t")).alias("s")).collect()
    assert dict(got) == {"a": "£", "b": "$", "c": "$", "d": "kr"}


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_pages_are_merged_in_one_shuffle(spark):
    """Lines are judged where their document stands, once; what is between two like lines counts only if it stays."""
    text = ["Date Description Amount", "coffee and cake", "", "Page 2", "Coffee  and cake", "Date Description", "tea", "tea", "coffee and cake", "coffee and cake"]
    page = [1, 1, 1, 1, 2, 2, 2, 2, 2, 3]
    frame = spark.createDataFrame([("d", p, i, t, 90.0, None, None) for i, (p, t) in enumerate(zip(page, text, strict=True))], LINES)
    kept, removed = lines.merge_pages(frame)
    assert shuffles(removed) == shuffles(lines.merge_stats(frame)) == 1  # of plans that have not run
    assert {r.line_index: r.reason for r in removed.collect()} == {2: "empty", 3: "page_footer", 4: "duplicate_boundary", 5: "repeated_header", 9: "duplicate_boundary"}
    assert sorted(r.line_index for r in kept.collect()) == [0, 1, 6, 7, 8]
    told = lines.merge_stats(frame).first()
    assert (told.lines_in, told.empty, told.repeated_header, told.page_footer, told.subtotal, told.continuation_marker, told.duplicate_boundary) == (10, 1, 1, 1, 0, 0, 2)


def test_items_are_grouped_in_one_shuffle(spark):
    items = spark.createDataFrame([("d", 1, 2.0, 20.1, "b"), ("d", 1, 1.0, 19.9, "a"), ("d", 1, 1.0, 10.0, "c"), ("d", 2, 1.0, 5.0, "e"), ("d", 2, 0.0, 5.0, " ")], "doc string, page_number int, x double, y double, text string")
    found = lines.group_items(items)
    assert shuffles(found) == 1  # of a plan that has not run
    assert {(r.page_number, r.line_index, r.text) for r in found.collect()} == {(1, 0, "a b"), (1, 1, "c"), (2, 0, "e")}
