"""Similarities of descriptions, as column expressions; only Jaro is an Arrow function.

Text is lower-cased throughout. Two normal forms differ on purpose: tokens turn other characters than a-z, 0-9 and white space into spaces, n-grams delete them.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.amounts import let

_SPACE = r"(?U)[\s\x{FEFF}]+"


def trim_all(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")


def normalize_tokens(c: Column) -> Column:
    """Lower case, other characters as spaces, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s\x{FEFF}]", " "), _SPACE, " "))


def normalize_ngrams(c: Column) -> Column:
    """Lower case, other characters deleted, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(c), r"(?U)[^a-z0-9\s\x{FEFF}]", ""), _SPACE, " "))


def tokens(c: Column) -> Column:
    """Words of the token form, in order, with repeats."""
    return F.filter(F.split(normalize_tokens(c), " "), lambda t: t != "")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - distance / longer length; two empty texts are equal."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def levenshtein_similarity_ci(a: Column, b: Column) -> Column:
    """The same, whatever the case."""
    return levenshtein_similarity(F.lower(a), F.lower(b))


def levenshtein_bounded(a: Column, b: Column, most: int) -> Column:
    """The distance, or -1 beyond `most`."""
    return F.levenshtein(a, b, most)


def _once(a: Column, b: Column, body) -> Column:
    """body of two values, each of which is worked out once, however often body names it."""
    return let(F.struct(a.alias("x"), b.alias("y")), lambda s: body(s["x"], s["y"]))


def _both(a: Column, b: Column, value: Column) -> Column:
    """1 if both arrays are empty, 0 if one is, else the value."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(value)


def sorted_words(c: Column) -> Column:
    """The words of the token form in order of the alphabet, as a text."""
    return F.array_join(F.array_sort(tokens(c)), " ")


def sorted_ratio(x: Column, y: Column) -> Column:
    """Levenshtein similarity of two texts of sorted words; 0 if one has none."""
    return F.when((x == "") & (y == ""), 1.0).when((x == "") | (y == ""), 0.0).otherwise(levenshtein_similarity(x, y))


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Levenshtein similarity of the sorted words."""
    return _once(sorted_words(a), sorted_words(b), sorted_ratio)


def _jaccard(x: Column, y: Column) -> Column:
    """Of two sets."""
    return let(F.size(F.array_intersect(x, y)), lambda shared: shared / (F.size(x) + F.size(y) - shared))


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; two empty ones are equal."""
    return _both(x, y, _jaccard(x, y))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Jaccard similarity of the sets of words."""
    return _once(F.array_distinct(tokens(a)), F.array_distinct(tokens(b)), set_similarity)


def token_containment(query: Column, target: Column, least: int = 2) -> Column:
    """How far the query's words are found in the target: the mean of 1 for a word, 0.8 for a part of its text, 0.6 for a beginning either way, and half the
    similarity of the first word that is three quarters alike."""
    asked = F.filter(tokens(query), lambda t: F.length(t) >= least)
    return words_contained(asked, normalize_tokens(target), F.array_distinct(tokens(target)))


def words_contained(asked: Column, text: Column, given: Column) -> Column:
    """The same for words that are asked for, and a target's token form and distinct words. For many pairs, make these once for each text."""

    def found(t: Column) -> Column:
        near = F.filter(given, lambda g: (F.length(g) >= 3) & (F.length(t) >= 3) & (levenshtein_similarity(t, g) >= 0.75))
        return (
            F.when(F.array_contains(given, t), 1.0)
            .when(F.contains(text, t), 0.8)
            .when(F.exists(given, lambda g: F.startswith(g, t) | F.startswith(t, g)), 0.6)
            .otherwise(F.coalesce(levenshtein_similarity(t, F.get(near, F.lit(0))) * 0.5, F.lit(0.0)))
        )

    total = F.aggregate(F.transform(asked, found), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(asked) == 0, 0.0).otherwise(F.least(F.lit(1.0), total / F.size(asked)))


def cut_ngrams(t: Column, n: int = 3) -> Column:
    """n-grams of a text that is in the n-gram form already; a shorter text is its only one."""
    parts = F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - (n - 1), F.lit(1))), lambda i: F.substring(t, i, F.lit(n)))
    return F.when(F.length(t) == 0, F.array().cast("array<string>")).otherwise(parts)


def ngrams(c: Column, n: int = 3) -> Column:
    """n-grams of the n-gram form in order; a shorter text is its only one."""
    return let(normalize_ngrams(c), lambda t: cut_ngrams(t, n))  # the form is worked out once, not for each n-gram


def ngram_similarity(a: Column, b: Column, n: int = 3) -> Column:
    """Jaccard similarity of the sets of n-grams."""
    return _once(F.array_distinct(ngrams(a, n)), F.array_distinct(ngrams(b, n)), set_similarity)


def _jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free = [True] * len(b)
    left = []
    for i, c in enumerate(a):
        j = b.find(c, max(0, i - reach), i + reach + 1)
        while j >= 0 and not free[j]:
            j = b.find(c, j + 1, i + reach + 1)
        if j >= 0:
            free[j] = False
            left.append(c)
    if not left:
        return 0.0
    right = [c for c, f in zip(b, free, strict=True) if not f]
    swapped = sum(x != y for x, y in zip(left, right, strict=True))
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3


def _jaro_winkler(a: str, b: str, scale: float, most: int) -> float:
    jaro = _jaro(a, b)
    if jaro in (0.0, 1.0):
        return jaro
    same = 0
    for x, y in zip(a[:most], b[:most], strict=False):
        if x != y:
            break
        same += 1
    return jaro + same * min(scale, 0.25) * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity; transpositions are halved without rounding."""
    return pd.Series([None if x is None or y is None else _jaro(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def jaro_winkler(a: Column, b: Column, scale: float = 0.1, most: int = 4) -> Column:
    """Jaro similarity raised by the length of a common prefix of at most `most` characters, at any similarity."""

    @F.pandas_udf(T.DoubleType())
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _jaro_winkler(p, q, scale, most) for p, q in zip(x, y, strict=True)], dtype="float64")

    return score(a, b)


def winkler(a: str, b: str) -> float:
    """The same for two Python texts, within a task."""
    return _jaro_winkler(a, b, 0.1, 4)


@lru_cache(100_000)
def distance(a: str, b: str) -> int:
    """Levenshtein distance of two Python texts, within a task."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _near_word(t: str, g: str, longer: int) -> float:
    """The Levenshtein similarity of two different words if it is at least 0.75, else 0. `longer` is the greater length, at least 4."""
    if longer < 8:  # one edit at most, which leaves a half as it is
        half = min(len(t), len(g)) // 2
        if t[:half] != g[:half] and t[-half:] != g[-half:]:
            return 0.0
        at = next((k for k, (x, y) in enumerate(zip(t, g, strict=False)) if x != y), min(len(t), len(g)))
        p, q = t[at:], g[at:]
        return 1 - 1 / longer if p[1:] == q[1:] or p[1:] == q or p == q[1:] else 0.0
    if len(set(t).difference(g)) > longer // 4:
        return 0.0
    alike = 1 - distance(t, g) / longer
    return alike if alike >= 0.75 else 0.0


def contained(asked: list[str], text: str, given: list[str]) -> float:
    """words_contained for Python texts, within a task."""
    if not asked:
        return 0.0
    total = 0.0
    for t in asked:
        if t in given:
            total += 1.0
        elif t in text:
            total += 0.8
        else:
            n = len(t)
            for g in given:
                if g[0] == t[0] and (g.startswith(t) or t.startswith(g)):
                    total += 0.6
                    break
            else:
                for g in given if n >= 3 else ():
                    m = len(g)
                    longer = n if n > m else m
                    if m >= 3 and n + m - longer >= longer - longer // 4 and longer >= 4:
                        alike = _near_word(t, g, longer)
                        if alike:
                            total += alike * 0.5
                            break
    return min(1.0, total / len(asked))


def jaro_winkler_ci(a: Column, b: Column) -> Column:
    """The same, whatever the case."""
    return jaro_winkler(F.lower(a), F.lower(b))


def description_similarity(a: Column, b: Column, weights) -> Column:
    """The weighted sum of Jaro-Winkler, token sort and containment (a is the query), at most 1."""
    total = jaro_winkler_ci(a, b) * weights.jaro_winkler + token_sort_ratio(a, b) * weights.token_sort + token_containment(a, b) * weights.token_containment
    return F.least(F.lit(1.0), total)


def description_scores(a: Column, b: Column, weights) -> Column:
    """All scores, their combination and which of the three counts most."""
    jw, ts, tc = jaro_winkler_ci(a, b), token_sort_ratio(a, b), token_containment(a, b)
    combined = F.least(F.lit(1.0), jw * weights.jaro_winkler + ts * weights.token_sort + tc * weights.token_containment)
    method = F.when((jw >= ts) & (jw >= tc), "jaroWinkler").when(ts >= tc, "tokenSort").otherwise("tokenContainment")
    return F.struct(combined.alias("combined"), jw.alias("jaro_winkler"), ts.alias("token_sort"), token_set_ratio(a, b).alias("token_set"), tc.alias("token_containment"), method.alias("method"))


def register(spark) -> None:
    """The Arrow functions by name, for SQL."""
    spark.udf.register("jaro", jaro)

    @F.pandas_udf(T.DoubleType())
    def plain(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if p is None or q is None else _jaro_winkler(p, q, 0.1, 4) for p, q in zip(x, y, strict=True)], dtype="float64")

    spark.udf.register("jaro_winkler", plain)
