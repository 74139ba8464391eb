"""Dates as people write them, read by column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.amounts import let

#: Names of months.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}
#: Formats in the order in which they are tried, with their patterns and the order of day, month and year in them. A year of two digits below 50 is in this century.
FORMATS = [
    ("YYYY-MM-DD", r"(\d{4})-(\d{1,2})-(\d{1,2})", "ymd"),
    ("YYYY/MM/DD", r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"),
    ("DD-MMM-YYYY", r"(\d{1,2})[-\s]([A-Za-z]{3,9})[-\s](\d{4})", "dny"),
    ("DD-MMM-YY", r"(\d{1,2})[-\s]([A-Za-z]{3,9})[-\s](\d{2})(?!\d)", "dny"),
    ("MMM DD, YYYY", r"([A-Za-z]{3,9})\s+(\d{1,2}),?\s+(\d{4})", "ndy"),
    ("DD MMM YYYY", r"(\d{1,2})\s+([A-Za-z]{3,9})\s+(\d{4})", "dny"),
    ("DD/MM/YYYY", r"(\d{1,2})/(\d{1,2})/(\d{4})", "dmy"),
    ("DD-MM-YYYY", r"(\d{1,2})-(\d{1,2})-(\d{4})", "dmy"),
    ("DD.MM.YYYY", r"(\d{1,2})\.(\d{1,2})\.(\d{4})", "dmy"),
    ("DD/MM/YY", r"(\d{1,2})/(\d{1,2})/(\d{2})(?!\d)", "dmy"),
    ("DD-MM-YY", r"(\d{1,2})-(\d{1,2})-(\d{2})(?!\d)", "dmy"),
    ("MM/DD/YYYY", r"(\d{1,2})/(\d{1,2})/(\d{4})", "mdy"),
    ("YYYYMMDD", r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)", "ymd"),
]


def _in_format(text: Column, pattern: str, order: str) -> Column:
    """The date of a pattern's first place in the text, null if there is none or it is no date of 1900 to 2100."""
    part = {}
    for i, what in enumerate(order, 1):
        found = F.regexp_extract(text, pattern, i)
        if what == "n":
            table = F.create_map(*[F.lit(x) for pair in MONTHS.items() for x in pair])
            part["m"] = F.try_element_at(table, F.lower(found))  # null for a word that is no month
        else:
            part[what] = F.when(found != "", found.try_cast("int"))
    year = part["y"] if r"(\d{4})" in pattern else F.when(part["y"] < 50, part["y"] + 2000).otherwise(part["y"] + 1900)
    iso = F.format_string("%04d-%02d-%02d", year, part["m"], part["d"])
    return F.when(year.between(1900, 2100) & part["m"].between(1, 12) & part["d"].between(1, 31), iso.try_cast("date"))


def parse_date(raw: Column, preferred: str | Column | None = None) -> Column:
    """struct(date, format) of the first format that gives a date, the preferred one before all others."""
    one = lambda t, n, p, o: let(_in_format(t, p, o), lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), F.lit(n).alias("format"))))

    def tried(t: Column) -> Column:
        if isinstance(preferred, Column):
            first = [F.when(preferred == f[0], one(t, *f)) for f in FORMATS]
        else:
            first = [one(t, *f) for f in FORMATS if f[0] == preferred]
        return F.coalesce(*first, *[one(t, *f) for f in FORMATS])

    return let(F.trim(raw), tried)


def detect_date_formats(samples, key: list[str]):
    """For each key of a table with `pos` and `sample`: the commonest `date_format` (of equals the one met first) and whether day and month may be confused, `unclear`."""
    read = samples.withColumn("format", parse_date(F.col("sample"))["format"]).where("format IS NOT NULL")
    number = lambda i: F.regexp_extract("sample", r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})", i).try_cast("int")
    each = read.groupBy(*key, "format").agg(F.count("*").alias("n"), F.min("pos").alias("first"), F.max(F.coalesce(number(1) > 12, F.lit(False))).alias("one"), F.max(F.coalesce(number(2) > 12, F.lit(False))).alias("two"))
    return each.groupBy(*key).agg(F.max_by("format", F.struct("n", -F.col("first"))).alias("date_format"), (~F.max("one") & ~F.max("two")).alias("unclear"))


def day_difference(a: Column, b: Column) -> Column:
    """Days between two dates, whichever is first."""
    return F.abs(F.datediff(a, b))


def date_key(c: Column) -> Column:
    """A date as text, zeros for none."""
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("0000-00-00"))
