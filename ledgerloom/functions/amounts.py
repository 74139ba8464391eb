"""Amounts as people write them, read by column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Currency signs and words that are no part of a number.
SIGNS = "[$£€₹¥₩]"
WORDS = r"\b(USD|EUR|GBP|INR|JPY|CHF|CAD|AUD)\b"
CREDIT, DEBIT = r"\s*(CR|Cr|cr|CREDIT|Credit)\s*$", r"\s*(DR|Dr|dr|DEBIT|Debit)\s*$"
#: Currency signs that are counted in amounts as text.
CURRENCIES = ["$", "£", "€", "₹", "¥", "₩", "R$", "CHF", "kr"]
#: Fixed value: what looks like an amount within a text.
IN_TEXT = r"[$£€₹¥]?\s*-?\(?\d[\d,. ]*\d\)?(?:\s*(?:CR|DR|Cr|Dr))?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def exact_sum(amount: Column) -> Column:
    """The sum of amounts without the error that adding doubles piles up, whatever their order: of decimals with six places; of doubles where one does not fit (above 1e22, not a number)."""
    exact = amount.try_cast("decimal(28,6)")
    return F.when(F.count(exact) == F.count(amount), F.sum(exact).cast("double")).otherwise(F.sum(amount))


def _has(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def _gone(c: Column, pattern: str, to: str = "") -> Column:
    return F.regexp_replace(c, pattern, to)


def _number(c: Column) -> Column:
    """The number a text begins with."""
    return F.regexp_extract(c, r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", 0).try_cast("double")


def _european(c: Column) -> Column:
    """Points out, the first comma to a point."""
    return _gone(_gone(c, r"\."), r"^([^,]*),", "$1.")


def _plain(c: Column) -> Column:
    """A number of unknown locale: the last separator decides; a lone comma before three digits separates thousands."""
    commas, points = F.regexp_count(c, F.lit(",")), F.regexp_count(c, F.lit(r"\."))
    comma_last = F.length(c) - F.locate(",", F.reverse(c)) > F.length(c) - F.locate(".", F.reverse(c))
    without = _gone(c, ",")
    after = F.length(F.regexp_extract(c, r",([^,]*)", 1))
    return (
        F.when((commas == 0) & (points <= 1), c)
        .when((commas == 1) & (points == 0), F.when(after <= 2, F.replace(c, F.lit(","), F.lit("."))).otherwise(without))
        .when(((commas >= 1) & (points == 1)) | ((points >= 1) & (commas == 1)), F.when(comma_last, _european(c)).otherwise(without))
        .when((commas > 1) & (points == 0), without)
        .when((points > 1) & (commas == 0), _gone(c, r"\."))
        .otherwise(F.concat(_gone(_gone(c, r"\.[^.]*$"), "[^0-9]"), F.lit("."), F.regexp_extract(c, r"\.([^.]*)$", 1)))
    )


def single_format(c: Column) -> Column:
    """US, EU, IN or AMBIGUOUS for one number."""
    return (
        F.when(_has(c, r",\d{3}\."), "US").when(_has(c, r"\.\d{3},"), "EU").when(_has(c, r"\d{1,2},\d{2},\d{3}"), "IN").when(_has(c, r"\.\d{2}$"), "US").when(_has(c, r",\d{2}$"), "EU").otherwise("AMBIGUOUS")
    )


def parse_amount(raw: Column, number_format: str | Column | None = None) -> Column:
    """struct(value, cents, is_negative, is_credit, confidence), null where there is no number.

    Debit marks, parentheses and a minus on either side make it negative; a credit mark does not make it positive.
    """
    text = F.regexp_replace(raw, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    bare = let(text, lambda t: F.struct(
        F.trim(_gone(_gone(F.when(_has(t, CREDIT), _gone(t, CREDIT)).otherwise(_gone(t, DEBIT)), SIGNS), f"(?i){WORDS}")).alias("s"),
        (_has(t, DEBIT) & ~_has(t, CREDIT)).alias("debit"), _has(t, CREDIT).alias("credit"),
        _has(_gone(t, r"[$£€₹\s]"), r"^\d{1,3}[.,]\d{3}$").alias("unclear")))
    inner = let(bare, lambda t: F.struct(
        F.trim(F.when(_has(t["s"], r"^\(.+\)$"), _gone(t["s"], r"^\(|\)$")).otherwise(t["s"])).alias("s"), (t["debit"] | _has(t["s"], r"^\(.+\)$")).alias("negative"), t["credit"].alias("credit"), t["unclear"].alias("unclear")))
    signed = let(inner, lambda t: F.struct(
        _gone(F.when(_has(t["s"], "^-"), _gone(t["s"], "^-")).otherwise(_gone(t["s"], "-$")), r"(?U)\s+").alias("s"), (t["negative"] | _has(t["s"], "^-|-$")).alias("negative"), t["credit"].alias("credit"), t["unclear"].alias("unclear")))

    def read(t: Column) -> Column:
        known = single_format(t["s"]) if number_format is None else F.lit(number_format) if isinstance(number_format, str) else number_format
        size = let(known, lambda k: _number(F.when(k.isin("US", "IN"), _gone(t["s"], ",")).when(k == "EU", _european(t["s"])).otherwise(_plain(t["s"]))))
        return F.when(_has(t["s"], r"\d"), let(size, lambda v: F.when(t["negative"], -F.abs(v)).otherwise(v)))

    def result(t: Column, v: Column) -> Column:
        sure = 0.9 - F.when(t["unclear"], 0.2).otherwise(0.0) - F.when(F.abs(v) > 10_000_000, 0.1).otherwise(0.0) - F.when(v == 0, 0.1).otherwise(0.0)
        return F.struct(
            v.alias("value"), F.floor(v * 100 + 0.5).cast("long").alias("cents"), t["negative"].alias("is_negative"), t["credit"].alias("is_credit"), F.greatest(F.lit(0.3), sure).alias("confidence")
        )

    return let(signed, lambda t: let(read(t), lambda v: F.when(v.isNotNull(), result(t, v))))


def amounts_in_text(text: Column, number_format: str | None = None) -> Column:
    """All amounts in a text, in order."""
    found = F.regexp_extract_all(text, F.lit(f"({IN_TEXT})"), 1)
    return F.filter(F.transform(found, lambda x: parse_amount(x, number_format)), lambda x: x.isNotNull())


def format_votes(raw: Column) -> Column:
    """struct(us, eu, ind, ambiguous): what one number says of its locale, null where there is no digit."""
    s = _gone(raw, r"(?U)[$£€₹¥₩R\s\x{FEFF}]")
    tail = F.substring(s, -6, 6)
    one = lambda pattern, weight, unless=None: F.when(_has(s, pattern) & (~unless if unless is not None else F.lit(True)), weight).otherwise(0)
    us = one(r",\d{3}\.", 10) + one(r"\.\d{2}$", 5, F.contains(tail, F.lit(","))) + one(r",\d{3}$", 2, F.contains(s, F.lit(".")))
    eu = one(r"\.\d{3},", 10) + one(r",\d{2}$", 5, F.contains(tail, F.lit("."))) + one(r"\.\d{3}$", 2, F.contains(s, F.lit(",")))
    unclear = _has(s, r"^\d{1,3}[.,]\d{3}$") & (us == 0) & (eu == 0)
    none = F.when(~_has(_gone(s, r"\.\d{1,2}$"), "[,.]"), 1).otherwise(0)
    return F.when(_has(s, r"\d"), F.struct((us + none).alias("us"), eu.alias("eu"), one(r"\d{1,2},\d{2},\d{3}", 10).alias("ind"), unclear.alias("ambiguous")))


def detect_number_format(votes: Column) -> Column:
    """An aggregate of format_votes: struct(format, config, confidence, samples, ambiguous). A format wins with twice the votes of both others."""
    us, eu, ind = (F.coalesce(F.sum(votes[k]), F.lit(0)) for k in ("us", "eu", "ind"))
    wins = lambda a, b, c: (a >= b * 2) & (a >= c * 2)
    total = us + eu + ind
    named = F.when(total == 0, "AMBIGUOUS").when(wins(us, eu, ind), "US").when(wins(eu, us, ind), "EU").when(wins(ind, us, eu), "IN").otherwise("AMBIGUOUS")
    config = F.when(named != "AMBIGUOUS", named).when((total == 0) | (us >= eu), "US").otherwise("EU")
    return F.struct(
        named.alias("format"), config.alias("config"), F.when(total > 0, F.greatest(us, eu, ind) / total).otherwise(0.0).alias("confidence"), F.count(votes).alias("samples"), F.count_if(votes["ambiguous"]).alias("ambiguous")
    )


def currency_symbol(raw: Column) -> Column:
    """An aggregate of amounts as text: the currency sign that most of them hold, of equals the first of CURRENCIES, a dollar where there is none."""
    counts = F.array(*[F.struct(F.count_if(F.contains(raw, F.lit(s))).alias("n"), F.lit(-i).alias("i"), F.lit(s).alias("s")) for i, s in enumerate(CURRENCIES)])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["s"]).otherwise("$")


def format_amount(value: Column, number_format: str = "US", symbol: str = "$", prefix: bool = True) -> Column:
    """An amount with its sign, grouping and currency sign."""
    cents = F.floor(F.abs(value) * 100 + 0.5).cast("long")
    whole, rest = F.floor(cents / 100).cast("string"), F.lpad((cents % 100).cast("string"), 2, "0")
    if number_format == "IN":
        last = F.right(whole, F.lit(3))
        head = F.substring(whole, F.lit(1), F.greatest(F.length(whole) - 3, F.lit(0)))
        grouped = F.when(F.length(head) > 0, F.concat(_gone(head, r"\B(?=(\d{2})+(?!\d))", ","), F.lit(","), last)).otherwise(whole)
    else:
        grouped = _gone(whole, r"\B(?=(\d{3})+(?!\d))", "." if number_format == "EU" else ",")
    number = F.concat(grouped, F.lit("," if number_format == "EU" else "."), rest)
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, F.lit(symbol), number) if prefix else F.concat(sign, number, F.lit(f" {symbol}"))
