import pathlib

import pytest

from ledgerloom.plans.engine import reconcile, type_histogram
from ledgerloom.scratch import scratch_dir
from ledgerloom.sources import csv_ledger, files


def write(folder, **texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / f"{name}.csv").write_text(text)
    return str(folder / "*.csv")


def test_two_files_a_side(spark, tmp_path):
    """Row numbers and ids are unique over all files of a side, so no entry is lost or matched twice."""
    head = "Date,Description,Amount\n"
    a = write(tmp_path / "a", one=head + "2024-01-05,rent,-100.00\n2024-01-06,fee,-7.00\n", two=head + "2024-02-05,salary,900.00\n2024-02-06,tax,-33.00\n")
    b = write(tmp_path / "b", one=head + "2024-01-05,RENT,100.00\n", two=head + "2025-03-05,other,5000.00\n")
    left, right = csv_ledger.read_ledger(spark, a, "A"), csv_ledger.read_ledger(spark, b, "B")
    assert sorted((r.id, r.row_index) for r in left.collect()) == [(f"A:{i}", i) for i in range(4)]
    got = {r.match_type: r.n_groups for r in type_histogram(reconcile(left, right).groups).collect()}
    assert got == {"exact": 1, "unmatched_a": 3, "unmatched_b": 1}


def test_files_that_cannot_be_read(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "c", good="Date,Amount\n01/02/2024,5\n", empty="", short="Date,Amount\n")
    with pytest.raises(ValueError, match="1 files cannot be read: .*empty.csv: File is empty"):
        csv_ledger.read_ledger(spark, path, "A")
    cells = csv_ledger.read_cells(spark, path, bad="skip")
    assert csv_ledger.parse_cells(cells, "A").count() == 1
    assert {(r.path.rsplit("/", 1)[1], r.warning[:11]) for r in csv_ledger.warnings(cells).collect()} == {("short.csv", "CSV has few"), ("good.csv", "Date format")}
    (tmp_path / "c" / "x.pdf").write_text("%PDF")
    kinds = {r.path.rsplit("/", 1)[1]: (r.kind, r.problem) for r in files.inspect(spark, str(tmp_path / "c")).collect()}
    assert kinds["x.pdf"] == ("pdf", None) and kinds["empty.csv"] == ("csv", "File is empty.")
    monkeypatch.setattr(files, "MOST_BYTES", 20)
    with pytest.raises(ValueError, match="too large"):
        csv_ledger.read_ledger(spark, path, "A")


def test_lines_are_cut_as_the_csv_module_cuts_them(spark, tmp_path):
    """Quotes, doubled quotes, quotes within cells, blank and ragged rows, all delimiters, a byte order mark, CR LF; a file of many splits; a cell over line ends."""
    rows = ['2024-01-05,"rent, ""flat"" 2",-100.00', '2024-01-06,5 "inch" pipe,-7.00', "", '2024-01-07,"tail"x,3', '""', "2024-01-08,short", '2024-01-09,"",4,extra,', " ,,", '2024-01-10," padded ",5']
    texts = {"comma": "Date,Description,Amount\n" + "\n".join(rows) + "\n", "bom": "﻿Date,Description,Amount\r\n" + "\r\n".join(rows), "bare": "\n".join(rows[:2]) + "\n", "one": "Date,Amount\n", "blank": "\n\n"}
    texts |= {name: "Date{0}Narration{0}Debit{0}Credit\n01/02/2024{0}a, b{0}1.00{0}\n02/02/2024{0}c{0}{0}2.00\n".format(mark) for name, mark in (("tab", "\t"), ("bar", "|"), ("semi", ";"))}
    texts["over"] = 'Date,Description,Amount\n2024-01-05,"two\nlines",-1.00\n2024-01-06,x"y,2\n'
    texts["many"] = "Date,Description,Amount\n" + "".join(f'2024-01-05,"row, {i}",{i}\n' + "\n" * (i % 3 == 0) for i in range(4000))
    path = write(tmp_path / "d", **texts)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        got = {}
        for r in csv_ledger.read_cells(spark, path).collect():
            got.setdefault(r.path.rsplit("/", 1)[1].removesuffix(".csv"), []).append((r.row_index, r.raw, r.style, r.headed, r.c_date, r.c_description, r.c_amount, r.c_debit, r.c_credit))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, text in texts.items():
        cut = csv_ledger.split_cells(text)
        if len(cut) < 2:
            assert [r[0] for r in got[name]] == [-1], name
            continue
        at, first = csv_ledger.columns_of(cut)
        cell = lambda row, role: row[at[role]].strip() if role in at and at[role] < len(row) else ""
        style = "separate" if "debit" in at and "credit" in at else "single"
        want = [(i, " | ".join(r), style, first > 0, *(cell(r, c) for c in ("date", "description", "amount", "debit", "credit"))) for i, r in enumerate(cut[first:])]
        assert sorted(got[name]) == want, name


def test_only_the_cells_stay(spark, tmp_path):
    """What is written on the way to the cells is deleted; the source files are not."""
    path = write(tmp_path / "g", plain="Date,Amount,Balance\n2024-01-05,5,1\n")
    held = lambda: {p.name for p in pathlib.Path(scratch_dir(spark).removeprefix("file://")).glob("csv-*")}
    before = held()
    cells = csv_ledger.read_cells(spark, path)
    assert [name.rsplit("-", 1)[0] for name in held() - before] == ["csv-cells"]
    assert cells.count() == 1 and csv_ledger.read_cells(spark, path).count() == 1


def test_size_is_an_option(spark, tmp_path, monkeypatch):
    path = write(tmp_path / "e", plain="Date,Amount,Balance\n2024-01-05,5,1\n2024-01-06,6,1\n")
    monkeypatch.setattr(files, "MOST_BYTES", 20)
    assert csv_ledger.read_ledger(spark, path, "A", most_bytes=1000).count() == 2
    over = write(tmp_path / "f", over='Date,Description,Amount\n2024-01-05,"two\nlines",-1.00\n')
    with pytest.raises(ValueError, match="go over line ends in files larger"):
        csv_ledger.read_ledger(spark, over, "A", most_bytes=1000)
