"""Ledgers from CSV files whose columns, number locale and date format are found out.

Files are read as lines by Spark, and cut into cells by column expressions, in as many tasks as a file has splits; only a file's first lines are looked at to find its delimiter and header. Files larger than
files.MOST_BYTES are refused unless another size is named, as are empty ones and those of other kinds.

A side's rows are numbered through all of its files, in order of their paths, so row numbers and ids are unique however many files and books a side has. Two calls for one party
number their rows alike: read all files of a side by one call.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import detect_number_format, exact_sum, format_votes, parse_amount
from ledgerloom.functions.dates import detect_date_formats, parse_date
from ledgerloom.schema import LEDGER
from ledgerloom.scratch import discard, materialize
from ledgerloom.sources import files

#: Words that name a column's role, in the order in which roles are tried.
HEADER_WORDS = {
    "date": ["date", "day", "txn date", "transaction date", "value date", "posting date"],
    "description": ["description", "narration", "particulars", "details", "memo", "narrative", "remarks"],
    "debit": ["debit", "dr", "dr.", "withdrawal", "withdrawals", "money out", "paid out", "charges"],
    "credit": ["credit", "cr", "cr.", "deposit", "deposits", "money in", "paid in", "receipts"],
    "amount": ["amount", "sum", "value"],
    "balance": ["balance", "running balance", "closing balance", "available balance"],
    "reference": ["ref", "reference", "ref no", "ref.", "chq no", "cheque no", "check no", "txn id", "transaction id"],
}
#: Roles by position where there is no header, by number of columns.
POSITIONS = {
    3: ["date", "description", "amount"],
    4: ["date", "description", "amount", "balance"],
    5: ["date", "description", "debit", "credit", "balance"],
    6: ["date", "description", "reference", "debit", "credit", "balance"],
}
ROLES = ["date", "description", "debit", "credit", "amount", "balance", "reference"]
#: Rows among which a header is sought, and data rows that formats are found out from.
HEADER_ROWS, SAMPLE_ROWS = 5, 20
#: Delimiters, and lines from which a file's is found out.
MARKS, HEAD_LINES = [",", "\t", "|", ";"], 10
#: What is cut off at both ends of a cell.
_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"

_CELLS = "path string, row_index long, raw string, style string, headed boolean, " + ", ".join(f"c_{r} string" for r in ROLES)


def role_of(header: str) -> str:
    """The role a header names: the first with a word that stands in it."""
    text = header.strip().lower()
    return next((role for role, words in HEADER_WORDS.items() if any(w in text for w in words)), "unknown")


def header_row(rows: list[list[str]]) -> int:
    """The first of the first rows whose text has words of two roles, or -1."""
    for i, row in enumerate(rows[:HEADER_ROWS]):
        text = " ".join(row).lower()
        if sum(any(w in text for w in words) for words in HEADER_WORDS.values()) >= 2:
            return i
    return -1


def columns_of(rows: list[list[str]]) -> tuple[dict[str, int], int]:
    """(index of each role that there is, number of rows before the data)."""
    at = header_row(rows)
    roles = [role_of(h) for h in rows[at]] if at >= 0 else POSITIONS[min(6, max(3, len(rows[0])))]
    return {role: roles.index(role) for role in ROLES if role in roles}, at + 1


def delimiter(lines: list[str]) -> str:
    """The mark that cuts lines most evenly into at least two cells."""

    def evenness(mark: str) -> tuple[int, float]:
        widths = [len(r) for r in csv.reader(lines, delimiter=mark)]
        mean = sum(widths) / max(1, len(widths))
        return (mean > 1.99, -sum(abs(w - mean) for w in widths), mean)

    return max(MARKS, key=evenness)


def split_cells(text: str) -> list[list[str]]:
    """Rows of cells; blank rows are left out. The delimiter is the one that cuts the first rows most evenly."""
    text = text.removeprefix("\ufeff")
    mark = delimiter([line for line in text.splitlines()[:HEAD_LINES] if line.strip()])
    return [r for r in csv.reader(io.StringIO(text), delimiter=mark) if r and r != [""]]


def _whole_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cells of files in which a cell goes over line ends: each is cut by one call."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in _CELLS.split(", ")]
        for batch in batches:
            for file, content in zip(batch["path"], batch["content"], strict=True):
                rows = split_cells(bytes(content).decode("utf-8", "replace"))
                if len(rows) < 2:
                    yield pd.DataFrame([(file, -1, "", "single", False, *("" for _ in ROLES))], columns=names)
                    continue
                at, first = columns_of(rows)
                style = "separate" if "debit" in at and "credit" in at else "single"
                cell = lambda row, role: row[at[role]].strip() if role in at and at[role] < len(row) else ""
                data = rows[first:]
                for start in range(0, len(data), 20_000):
                    yield pd.DataFrame(
                        [(file, i, " | ".join(r), style, first > 0, *(cell(r, role) for role in ROLES)) for i, r in enumerate(data[start : start + 20_000], start)], columns=names
                    )

    read = spark.read.format("binaryFile").load(paths)
    return read.select(files.plain(F.col("path")).alias("path"), "content").mapInPandas(cut, _CELLS)


def _sniffed(heads: DataFrame) -> DataFrame:
    """(path, mark, first, at): delimiter, rows before the data and index of each role (-1: none), from the first lines of each file, which alone come to Python."""

    @F.pandas_udf("mark string, first int, at array<int>")
    def sniff(lines: pd.Series) -> pd.DataFrame:
        out = []
        for head in lines:
            mark = delimiter([x for x in head if x.strip()])
            rows = [r for r in csv.reader(head, delimiter=mark) if r and r != [""]]
            at, first = columns_of(rows) if rows else ({}, 0)
            out.append((mark, first, [at.get(role, -1) for role in ROLES]))
        return pd.DataFrame(out, columns=["mark", "first", "at"])

    return heads.select("path", sniff("head").alias("s")).select("path", "s.*")


#: A quoted cell up to the mark that closes it; what stands behind it up to the delimiter belongs to the cell as it is.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def _raw_cells(line: Column, mark: Column) -> Column:
    """The cells of a line as they are written."""
    cut = lambda m: F.regexp_extract_all(F.concat(F.lit(m), line), F.lit(f"{re.escape(m)}({_QUOTED}[^{re.escape(m)}]*+|[^{re.escape(m)}]*+)"), F.lit(1))
    return reduce(lambda told, m: told.when(mark == m, cut(m)), MARKS[1:], F.when(mark == MARKS[0], cut(MARKS[0])))


def _cell(raw: Column) -> Column:
    """A cell without its quotes."""
    quoted = F.regexp_extract(raw, "^" + _QUOTED, 0)
    inner = F.replace(F.substring(quoted, F.lit(2), F.length(quoted) - 2), F.lit('""'), F.lit('"'))
    return F.when(quoted == "", raw).otherwise(F.concat(inner, F.substring(raw, F.length(quoted) + 1, F.length(raw))))


def read_cells(spark: SparkSession, path: str, bad: str = "refuse", most_bytes: int | None = None) -> DataFrame:
    """One row for each data row of each file, its cells by role, and a row numbered -1 for a file of fewer than two rows. It is written, as what follows reads it several times.

    Files are read as lines, in as many tasks as they have splits; a row's number is that of its split's rows before it and of the rows of the splits before. Only the first lines of a file are looked at
    to find its delimiter and header. A file in which a quoted cell goes over line ends is cut as a whole instead, so its size is bounded by files.MOST_BYTES in any case.

    bad: "refuse" raises if a file is too large, empty or no CSV file; "skip" leaves such files out (files.inspect names them). most_bytes: what is too large; by default files.MOST_BYTES.
    """
    most = files.MOST_BYTES if most_bytes is None else most_bytes
    if bad == "refuse":
        files.refuse_bad(spark, path, "csv", most)
    listed = files.inspect(spark, path, most).where("problem IS NULL AND kind = 'csv'").select("path")
    at = files.plain(F.col("_metadata.file_path"))
    text = spark.read.text(path).where((F.col("_metadata.file_size") <= most) & (files.kind_of(F.col("_metadata.file_path")) == "csv"))
    line = F.regexp_replace("value", "^\ufeff", "")
    rows = text.select(at.alias("path"), F.col("_metadata.file_block_start").alias("block"), line.alias("line")).where(~F.col("line").isin("", '""'))
    lines = materialize(rows.withColumn("at_row", F.monotonically_increasing_id()), "csv-lines")  # consecutive within a split, which is part of one task
    splits = lines.groupBy("path", "block").agg(F.min("at_row").alias("low"), F.count("*").alias("n"))
    in_file = Window.partitionBy("path")
    before = F.coalesce(F.sum("n").over(in_file.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = materialize(splits.withColumns({"start": before, "n": F.sum("n").over(in_file)}), "csv-splits")
    numbered = lines.join(splits, ["path", "block"]).withColumn("row", F.col("at_row") - F.col("low") + F.col("start"))
    heads = numbered.where(F.col("row") < HEAD_LINES).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("row", "line")))["line"].alias("head"))
    known = materialize(_sniffed(heads), "csv-dialects")
    split = numbered.join(known, "path").withColumn("raw", _raw_cells(F.col("line"), F.col("mark")))
    open_cell = F.exists("raw", lambda x: x.startswith('"') & ~x.rlike("^" + _QUOTED))
    cells = F.transform("raw", _cell)
    of = lambda i: F.trim(F.coalesce(F.get("cells", F.get("at", F.lit(i))), F.lit("")), F.lit(_BLANKS))
    separate = (F.get("at", F.lit(ROLES.index("debit"))) >= 0) & (F.get("at", F.lit(ROLES.index("credit"))) >= 0)
    made = split.select("path", "row", "first", "at", "n", open_cell.alias("open"), cells.alias("cells"))
    shaped = materialize(made.select(
        "path", (F.col("row") - F.col("first")).alias("row_index"), F.array_join("cells", " | ").alias("raw"), F.when(separate, "separate").otherwise("single").alias("style"), (F.col("first") > 0).alias("headed"),
        *[of(i).alias(f"c_{role}") for i, role in enumerate(ROLES)], "n", "open",
    ), "csv-shaped")
    whole = [r.path for r in shaped.where("open").select("path").distinct().collect()]  # names of files; usually none
    names = [x.split()[0] for x in _CELLS.split(", ")]
    result = shaped.where("n >= 2 AND row_index >= 0")
    short = listed.join(splits.where("n >= 2").select("path").distinct(), "path", "left_anti")
    if whole:
        large = files.inspect(spark, path, files.MOST_BYTES).where((F.col("length") > files.MOST_BYTES) & F.col("path").isin(whole)).select("path").collect()
        if large:
            raise ValueError(f"cells go over line ends in files larger than {files.MOST_BYTES} bytes: {', '.join(sorted(r.path for r in large))}")
        result, short = result.where(~F.col("path").isin(whole)), short.where(~F.col("path").isin(whole))
    empty = short.select("path", F.lit(-1).cast("long").alias("row_index"), F.lit("").alias("raw"), F.lit("single").alias("style"), F.lit(False).alias("headed"), *[F.lit("").alias(f"c_{r}") for r in ROLES])
    result = result.select(*names).unionByName(empty)
    done = materialize(result.unionByName(_whole_files(spark, whole)) if whole else result, "csv-cells")
    discard(lines, splits, known, shaped)
    return done


def _formats(cells: DataFrame) -> DataFrame:
    """(path, number_format, date_format, unclear, start): what each file's first data rows say, and how many rows the files before it have. One row a file."""
    first = cells.where((F.col("row_index") >= 0) & (F.col("row_index") < SAMPLE_ROWS))
    kinds = [F.when(F.col(f"c_{r}") != "", F.col(f"c_{r}")) for r in ("debit", "credit", "amount", "balance")]
    numbers = first.select("path", F.explode(F.array(*kinds)).alias("s")).where("s IS NOT NULL").select("path", format_votes(F.col("s")).alias("v"))
    number = numbers.groupBy("path").agg(detect_number_format(F.col("v"))["config"].alias("number_format"))
    dates = detect_date_formats(first.where("c_date <> ''").select("path", F.col("row_index").alias("pos"), F.col("c_date").alias("sample")), ["path"])
    sizes = cells.groupBy("path").agg((F.max("row_index") + 1).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = sizes.withColumn("start", start).drop("n")
    return numbered.join(number, "path", "left").join(dates, "path", "left").na.fill({"number_format": "US", "date_format": "DD/MM/YYYY", "unclear": False})


def parse_cells(cells: DataFrame, party: str, book: str = "0", lone_side: bool = True) -> DataFrame:
    """Typed ledger entries. Number and date formats are found out from each file's first data rows.

    book: a SQL expression over `path`. lone_side: a file with a debit or credit column but not both still has its amounts (False: they are lost).
    """
    known = cells.where("row_index >= 0").join(_formats(cells).drop("unclear"), "path").withColumn("row_index", F.col("start") + F.col("row_index"))
    amount = lambda r: parse_amount(F.col(f"c_{r}"), F.col("number_format"))["value"]
    read = known.select(
        "path", "row_index", "raw", "style", parse_date(F.col("c_date"), F.col("date_format"))["date"].alias("date"), F.col("c_description").alias("description"),
        *[amount(r).alias(r) for r in ("debit", "credit", "amount", "balance")], F.when(F.col("c_reference") != "", F.col("c_reference")).alias("ref_number"),
    )
    both = F.col("style") == "separate"
    lone = lambda r: F.when(F.col("amount").isNull() & F.lit(lone_side), F.abs(F.col(r)))
    debit = F.when(both, F.abs("debit")).when(F.col("amount") < 0, -F.col("amount")).otherwise(lone("debit"))
    credit = F.when(both, F.abs("credit")).when(F.col("amount") >= 0, F.col("amount")).otherwise(lone("credit"))
    money = read.withColumns({"debit": debit, "credit": credit})
    usable = money.where("date IS NOT NULL OR debit IS NOT NULL OR credit IS NOT NULL OR description <> ''")
    net = (F.coalesce("credit", F.lit(0.0)) - F.coalesce("debit", F.lit(0.0))).alias("net")
    entries = usable.withColumn("amount", net).select(
        F.expr(book).cast("long").alias("book"), F.concat_ws(":", F.lit(party), F.col("row_index").cast("string")).alias("id"), F.lit(party).alias("party"), "row_index", F.lit(1).alias("page_number"), "date",
        "description", "debit", "credit", "balance", "ref_number", "amount", F.abs("amount").alias("amount_abs"), F.floor(F.col("amount") * 100 + 0.5).cast("long").alias("amount_cents"),
        F.col("raw").alias("raw_text"), F.lit(100.0).alias("ocr_confidence"),
    )
    return entries.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER.fields])


def read_ledger(spark: SparkSession, path: str, party: str, book: str = "0", lone_side: bool = True, bad: str = "refuse", most_bytes: int | None = None) -> DataFrame:
    """The entries of all CSV files of a path. Files that cannot be read raise, or with bad="skip" are left out."""
    return parse_cells(read_cells(spark, path, bad, most_bytes), party, book, lone_side)


def warnings(cells: DataFrame) -> DataFrame:
    """(path, warning): files of fewer than two rows, and those whose dates may be read in two ways."""
    short = cells.where("row_index < 0").select("path", F.lit("CSV has fewer than 2 rows").alias("warning"))
    unclear = _formats(cells).where("unclear").select("path", F.format_string("Date format is ambiguous (DD/MM vs MM/DD). Using %s. You can override this in settings.", "date_format").alias("warning"))
    return short.unionByName(unclear)


def ledger_summary(entries: DataFrame) -> DataFrame:
    """One row for each book and party: rows, rows with and without a date, rows of low confidence, totals, dates and mean confidence."""
    debit, credit = (F.coalesce(exact_sum(F.col(c)), F.lit(0.0)) for c in ("debit", "credit"))
    return entries.groupBy("book", "party").agg(
        F.count("*").alias("total_rows"), F.count("date").alias("valid_rows"), (F.count("*") - F.count("date")).alias("skipped_rows"), F.count_if(F.col("ocr_confidence") < 70).alias("low_confidence_rows"),
        debit.alias("total_debit"), credit.alias("total_credit"),
        (credit - debit).alias("net_amount"), F.min("date").alias("earliest"), F.max("date").alias("latest"),
        (F.floor(F.avg("ocr_confidence") * 100 + 0.5) / 100).alias("average_confidence"),
    )
