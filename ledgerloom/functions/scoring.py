"""Tolerances, confidences and reasons, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import MatchConfig


def round_half_up(c: Column) -> Column:
    """To the nearest whole number, halves upwards (also below zero)."""
    return F.floor(c + 0.5)


def comparable_amount(amount: Column, mode: str) -> Column:
    """The amount under a polarity mode."""
    return F.abs(amount) if mode == "absolute" else -amount if mode == "opposite_sign" else amount


def amounts_match(a: Column, b: Column, config: MatchConfig) -> Column:
    """Within the percentage of the larger, or the fixed difference, as the mode says."""
    diff = F.abs(a - b)
    percent = diff <= F.greatest(F.abs(a), F.abs(b)) * config.amount_tolerance_percent
    fixed = diff <= config.amount_tolerance_fixed
    return {"percent": percent, "fixed": fixed, "both": percent | fixed}[config.amount_tolerance_mode]


def amounts_exact(a: Column, b: Column) -> Column:
    """Less than a cent apart."""
    return F.abs(a - b) < 0.01


def day_difference(a: Column, b: Column) -> Column:
    """Days between two dates, -1 where one is missing."""
    return F.coalesce(F.abs(F.datediff(a, b)), F.lit(-1))


def dates_match(a: Column, b: Column, days: int) -> Column:
    """Within so many days; a missing date matches any."""
    return day_difference(a, b) <= days


def normalize_ref(ref: Column, case_sensitive: bool = False) -> Column:
    """Letters and digits alone."""
    kept = F.regexp_replace(ref, "[^a-zA-Z0-9]", "")
    return kept if case_sensitive else F.lower(kept)


def refs_match(a: Column, b: Column, case_sensitive: bool = False) -> Column:
    """Both there, with equal letters and digits, of which there are some."""
    x, y = normalize_ref(a, case_sensitive), normalize_ref(b, case_sensitive)
    return F.coalesce((x == y) & (x != ""), F.lit(False))


def _clamped(score: Column) -> Column:
    return round_half_up(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int")


def _penalty(diff: Column, base: Column, weight: float) -> Column:
    return F.when((diff >= 0.01) & (base > 0), diff / base * weight).otherwise(0.0)


def confidence_amount_date(days: Column, diff: Column, base: Column, ref: Column) -> Column:
    """95, less 3 a day and the difference in percent, 5 more for equal references."""
    return _clamped(95 - F.when(days > 0, days * 3).otherwise(0) - _penalty(diff, base, 100) + F.when(ref, 5).otherwise(0))


def confidence_fuzzy(similarity: Column, days: Column, diff: Column, base: Column, ref: Column) -> Column:
    """65 and up to 30 for the description, less 2 a day and half the difference in percent, 10 more for equal references."""
    return _clamped(65 + similarity * 30 - F.when(days > 0, days * 2).otherwise(0) - _penalty(diff, base, 50) + F.when(ref, 10).otherwise(0))


def money(amount: Column) -> Column:
    """Dollars with two decimals, from whole cents."""
    cents = round_half_up(F.abs(amount) * 100).cast("long")
    return F.concat(F.when(amount < 0, "-").otherwise(""), (cents / 100).cast("long").cast("string"), F.lit("."), F.lpad((cents % 100).cast("string"), 2, "0"))


def _amount_part(diff: Column, base: Column) -> Column:
    return F.when(diff < 0.01, F.concat(F.lit("amount identical ($"), money(base), F.lit(")"))).otherwise(F.concat(F.lit("amount within tolerance (±$"), money(diff), F.lit(")")))


def _days_part(days: Column) -> Column:
    return F.when(days == 0, "same date").when(days > 0, F.concat(days.cast("string"), F.when(days > 1, " days apart").otherwise(" day apart")))


def reason_exact(base: Column, ref: Column) -> Column:
    """Why two entries match exactly."""
    return F.concat(F.lit("Exact match: "), F.concat_ws(", ", F.lit("date identical"), F.concat(F.lit("amount identical ($"), money(base), F.lit(")")), F.when(ref, "reference number identical")))


def reason_amount_date(days: Column, diff: Column, base: Column, ref: Column) -> Column:
    """Why two entries match by amount and date."""
    return F.concat(F.lit("Amount + Date match: "), F.concat_ws(", ", _amount_part(diff, base), F.coalesce(_days_part(days), F.lit("date not compared")), F.when(ref, "reference number matches")))


def reason_fuzzy(similarity: Column, days: Column, diff: Column, base: Column) -> Column:
    """Why two entries match by description."""
    alike = F.concat(F.lit("description "), round_half_up(similarity * 100).cast("string"), F.lit("% similar"))
    return F.concat(F.lit("Fuzzy match: "), F.concat_ws(", ", alike, _amount_part(diff, base), _days_part(days)))


def reason_split(base: Column, count: Column, total: Column) -> Column:
    """Why one entry matches several."""
    return F.concat(F.lit("Split transaction: 1 entry ($"), money(base), F.lit(") matches "), count.cast("string"), F.lit(" entries totaling $"), money(total))


def reason_unmatched(side: str, config: MatchConfig) -> Column:
    """Why an entry of a side is left over."""
    other = "B" if side == "A" else "A"
    return F.lit(f"Unmatched: no corresponding entry found in Ledger {other} within ±{config.date_tolerance_days} days and ±{config.amount_tolerance_percent * 100:.1f}% amount tolerance")


def reason_duplicate(count: Column) -> Column:
    """Why entries of one side are duplicates."""
    return F.concat(F.lit("Duplicate: "), count.cast("string"), F.lit(" identical entries found on same ledger side"))


def content_key(date: Column, cents: Column, description: Column, ref: Column) -> Column:
    """What equal entries of one side have in common."""
    from ledgerloom.functions.text import trim_all

    return F.concat_ws("|", F.coalesce(date.cast("string"), F.lit("")), cents.cast("string"), F.substring(trim_all(F.lower(F.coalesce(description, F.lit("")))), 1, 50), F.coalesce(ref, F.lit("")))
