"""Similarity and comparison functions.

The indel ratio has no built-in: it runs in Arrow batches, on distinct pairs of each batch only,
by the bit-parallel longest common subsequence. Everything else is built in.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritrail.functions.text import CONFUSED, despaced, enumerator_fold, sorted_tokens

DIFFERENCES = T.ArrayType(T.StructType([T.StructField("position", T.IntegerType()), *[T.StructField(n, T.StringType()) for n in ("expected", "found", "kind")]]))
ML_PER_FL_OZ = 29.5735
# Metric units of volume in millilitres.
METRIC = {
    "ML": 1.0, "MILLILITER": 1.0, "MILLILITERS": 1.0, "MILLILITRE": 1.0, "MILLILITRES": 1.0,
    "CL": 10.0, "CENTILITER": 10.0, "CENTILITERS": 10.0, "CENTILITRE": 10.0, "CENTILITRES": 10.0,
    "L": 1000.0, "LITER": 1000.0, "LITERS": 1000.0, "LITRE": 1000.0, "LITRES": 1000.0,
}


def common_length(a, b) -> int:
    """Length of the longest common subsequence of two strings or token lists."""
    if len(a) > len(b):
        a, b = b, a
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for x in b:
        hit = row & places.get(x, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def indel(a, b) -> float:
    """2 LCS / (sum of lengths): 1 for two empty values, 0 if just one is empty."""
    total = len(a) + len(b)
    return 2 * common_length(a, b) / total if total else 1.0


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict = {}
    out = []
    for pair in zip(a, b):
        if pair not in known:
            known[pair] = None if pair[0] is None or pair[1] is None else indel(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_list_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel(list(x), list(y)) for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """No ratio of texts of these lengths is greater; cheap, to filter before ratio()."""
    total = F.char_length(a) + F.char_length(b)
    return F.when(total > 0, 2 * F.least(F.char_length(a), F.char_length(b)) / total).otherwise(F.lit(1.0))


def text_similarity(a: Column, b: Column) -> Column:
    """Of canonical texts: the better of the ratios of sorted tokens and of the texts without spaces."""
    return F.greatest(ratio(sorted_tokens(a), sorted_tokens(b)), ratio(despaced(a), despaced(b)))


def residual_edits(a: Column, b: Column) -> Column:
    return F.levenshtein(despaced(a), despaced(b))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length: a built-in similarity for SQL-checked queries."""
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest > 0, 1 - F.levenshtein(a, b) / longest).otherwise(F.lit(1.0))


def length_penalty(words: Column, expected_words: Column, weight: float) -> Column:
    return F.greatest(F.lit(0.1), 1 - F.greatest(F.lit(0), words - expected_words) * weight)


def confidence_factor(confidence: Column, weight: float | Column) -> Column:
    w = F.least(F.lit(1.0), F.greatest(F.lit(0.0), weight)) if isinstance(weight, Column) else min(1.0, max(0.0, weight))
    return F.lit(1 - w) + F.lit(w) * confidence


def verdict(confidence: Column, score: Column, match: float, mismatch: float, floor: float) -> Column:
    return F.when(confidence < floor, "REVIEW").when(score >= match, "MATCH").when(score <= mismatch, "MISMATCH").otherwise("REVIEW")


def equal_2dp(a: Column, b: Column) -> Column:
    return F.round(a, 2) == F.round(b, 2)


def agrees(a: Column, b: Column, tolerance: Column | float, converted: Column) -> Column:
    tolerance = tolerance if isinstance(tolerance, Column) else F.lit(tolerance)
    return F.when(converted, F.abs(a - b) <= tolerance + 1e-9).otherwise(equal_2dp(a, b))


def to_ml(value: Column, unit: Column) -> Column:
    """Millilitres of a value in a metric unit or in fluid ounces ("FL OZ"); null for others."""
    table = F.create_map(*[F.lit(x) for kv in (METRIC | {"FL OZ": ML_PER_FL_OZ}).items() for x in kv])
    return value * F.try_element_at(table, F.upper(unit))


def proof_to_abv(value: Column) -> Column:
    return F.when(value.between(0, 200), value / 2)


def percent(value: Column) -> Column:
    return F.when(value.between(0, 100), value)


def triage_score(agreement: Column, confidence: Column, penalty: Column, bonus: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), agreement * (0.7 + 0.3 * confidence) * penalty + bonus)), 4)


def one_decimal(value: Column) -> Column:
    """At most one decimal, without trailing zeros."""
    return F.regexp_replace(F.format_string("%.1f", value), r"\.0$", "")


def token_class(expected: Column, found: Column, least: int | Column = 5) -> Column:
    """noise, ambiguous or wording: what a substituted statutory word amounts to."""
    # only equality looks beyond enumerators read as letters: a digit is no vowel
    e, f = expected, found
    distance = F.levenshtein(e, f)
    pairs = F.zip_with(F.split(e, ""), F.split(f, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    changed = F.filter(pairs, lambda p: p["x"] != p["y"])
    vowel = lambda c: c.isin("A", "E", "I", "O", "U")
    vowels = (F.char_length(e) == F.char_length(f)) & F.forall(changed, lambda p: vowel(p["x"]) & vowel(p["y"]))
    return (
        F.when(enumerator_fold(e) == enumerator_fold(f), "noise")
        .when(F.char_length(e) < least, "wording")
        .when(F.startswith(e, f) | F.startswith(f, e), "wording")
        .when((distance == 1) & ~vowels, "noise")
        .when(distance == 2, "ambiguous")
        .otherwise("wording")
    )


def _band(a: str, b: str, width: int) -> list[dict[int, int]]:
    """Edit distances of prefixes whose lengths differ by width at most."""
    far = len(a) + len(b) + 1
    rows = [{j: j for j in range(min(width, len(b)) + 1)}]
    for i in range(1, len(a) + 1):
        last, row = rows[-1], {}
        for j in range(max(0, i - width), min(len(b), i + width) + 1):
            row[j] = min(last.get(j, far) + 1, row.get(j - 1, far) + 1, last.get(j - 1, far) + (a[i - 1] != b[j - 1]) if j else far)
        rows.append(row)
    return rows


def edits(expected: str, found: str, most: int = 3) -> list[dict]:
    """Up to most described edits on one shortest path; substitutions within a confusion class are passed over."""
    n, m = len(expected), len(found)
    band = 8
    while (cost := _band(expected, found, band))[n].get(m, band + 1) > band:
        band *= 2  # a distance within the band is exact, as no shortest path leaves it
    far = n + m + 1
    at = lambda i, j: cost[i].get(j, far)
    out, i, j = [], n, m
    while i or j:
        if i and j and at(i, j) == at(i - 1, j - 1) + (expected[i - 1] != found[j - 1]):
            i, j = i - 1, j - 1
            if CONFUSED.get(expected[i], expected[i]) != CONFUSED.get(found[j], found[j]):
                out.append({"position": i, "expected": expected[i], "found": found[j], "kind": "substituted"})
        elif i and at(i, j) == at(i - 1, j) + 1:
            i -= 1
            out.append({"position": i, "expected": expected[i], "found": None, "kind": "missing"})
        else:
            j -= 1
            out.append({"position": i, "expected": None, "found": found[j], "kind": "extra"})
    return out[::-1][:most]


@F.pandas_udf(DIFFERENCES)
def edit_operations(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else edits(x, y) for x, y in zip(a, b)])


def nearest_rank(n: int, p: float) -> int:
    return min(n, max(1, math.ceil(p / 100 * n)))
