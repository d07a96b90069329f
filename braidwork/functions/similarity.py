"""String, number and date similarities. All are Column expressions but Jaro-Winkler, which is an Arrow function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def exact(a: Column, b: Column) -> Column:
    strip = lambda c: F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.coalesce((strip(a) == strip(b)).cast("double"), F.lit(0.0))


def levenshtein(a: Column, b: Column) -> Column:
    """1 minus distance over the longer length, without case; 0 if either is null or empty."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), 1.0 - F.levenshtein(F.lower(a), F.lower(b)) / longer).otherwise(F.lit(0.0))


def jaro_winkler_value(s: str | None, t: str | None) -> float:
    """Jaro with a prefix bonus of 0.1 for each of up to 4 letters, at any Jaro value; half transpositions count half."""
    if not s or not t:
        return 0.0
    s, t = s.lower(), t.lower()
    if s == t:
        return 1.0
    reach = max(0, max(len(s), len(t)) // 2 - 1)
    used, left = [False] * len(t), []
    for i, ch in enumerate(s):
        for j in range(max(0, i - reach), min(len(t), i + reach + 1)):
            if not used[j] and t[j] == ch:
                used[j] = True
                left.append(ch)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for c, u in zip(t, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) / 2
    jaro = (m / len(s) + m / len(t) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(s), len(t)) and s[prefix] == t[prefix]:
        prefix += 1
    return jaro + 0.1 * prefix * (1 - jaro)


def jaro_winkler(a: Column, b: Column) -> Column:
    @F.pandas_udf("double")
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        return pd.Series([jaro_winkler_value(x, y) for x, y in zip(s, t)])

    return run(a, b)


def token_jaccard(a: Column, b: Column) -> Column:
    """Jaccard index of the words; 1 if both have none, 0 if one has."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    x, y = words(a), words(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(x, y)) / union)


def phonetic_code(c: Column) -> Column:
    """First character and three digits: vowels, h, w, y and all but letters are dropped before equal codes fall together; empty gives 0000."""
    up = F.upper(c)
    tail = F.regexp_replace(F.substring(up, F.lit(2), F.length(up)), "[^A-Z]", "")
    codes = F.regexp_replace(F.translate(tail, "BFPVCGJKQSXZDTLMNR", "111122222222334556"), "[^1-6]", "")
    folded = F.regexp_replace(codes, r"(.)\1+", "$1")
    return F.when(F.length(c) > 0, F.rpad(F.substring(F.concat(F.substring(up, 1, 1), folded), 1, 4), 4, "0")).otherwise(F.lit("0000"))


def phonetic(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(0.0)).otherwise((phonetic_code(a) == phonetic_code(b)).cast("double"))


def numeric(a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """1 if equal, 1 minus the relative difference up to the tolerance, else 0; 0 if either is no number."""
    x, y = a.try_cast("double"), b.try_cast("double")
    gap = F.abs(x - y) / F.greatest(F.abs(x), F.abs(y))
    return F.coalesce(F.when(x == y, F.lit(1.0)).when(gap <= tolerance, 1.0 - gap), F.lit(0.0))


def dates(a: Column, b: Column, most_days: int = 30) -> Column:
    """1 minus days apart over most_days, 0 beyond or if either is no ISO date."""
    day = lambda c: F.try_to_date(F.substring(c.cast("string"), 1, 10), "yyyy-MM-dd")
    gap = F.abs(F.datediff(day(a), day(b)))
    return F.coalesce(F.when(gap <= most_days, 1.0 - gap / most_days), F.lit(0.0))


METRICS: dict[str, Callable[[Column, Column], Column]] = {"exact": exact, "levenshtein": levenshtein, "jaro_winkler": jaro_winkler, "token": token_jaccard, "phonetic": phonetic}


def register_metrics(spark: SparkSession) -> None:
    """Makes Jaro-Winkler known to SQL text; the others are SQL already."""
    spark.udf.register("jaro_winkler", F.pandas_udf(lambda s, t: pd.Series([jaro_winkler_value(x, y) for x, y in zip(s, t)]), "double"))
