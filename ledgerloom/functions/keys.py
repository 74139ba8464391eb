"""Hashes and keys of entries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions.dates import date_key
from ledgerloom.functions.scoring import normalize_ref

#: Offset basis and prime of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def sha256(c: Column) -> Column:
    """SHA-256 in hexadecimal."""
    return F.sha2(c, 256)


def fnv1a(c: Column) -> Column:
    """FNV-1a over the code points of a text, 32 bits in eight hexadecimal digits."""
    codes = F.transform(F.filter(F.split(c, ""), lambda x: x != ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: (h.bitwiseXOR(x) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.lower(F.lpad(F.hex(F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), step)), 8, "0"))


def amount_to_cents(c: Column) -> Column:
    """Whole cents, halves upwards."""
    return F.floor(c * 100 + 0.5).cast("long")


def match_key(date: Column, amount: Column, ref: Column) -> Column:
    """Date, absolute cents and reference of an entry as one text."""
    return F.concat_ws("|", date_key(date), amount_to_cents(F.abs(amount)).cast("string"), normalize_ref(F.coalesce(ref, F.lit(""))))
