"""String similarities over pairs of columns, in Arrow batches: run them after a candidate step. Each distinct pair of a batch is computed once."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity with a bonus of 0.1 for each of up to four equal first letters."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, left = [True] * len(b), []
    for i, x in enumerate(a):
        at = next((j for j in range(max(0, i - reach), min(i + reach + 1, len(b))) if free[j] and b[j] == x), -1)
        if at >= 0:
            free[at] = False
            left.append(x)
    if not left:
        return 0.0
    right = [y for y, unused in zip(b, free) if not unused]
    m, swapped = len(left), sum(x != y for x, y in zip(left, right))
    jaro = (m / len(a) + m / len(b) + (m - swapped / 2) / m) / 3
    same = next((k for k, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    return jaro + 0.1 * same * (1 - jaro)


def damerau_of(a: str, b: str) -> int:
    """Unrestricted Damerau-Levenshtein distance: edits and swaps of neighbours, between which edits may lie."""
    worst, seen = len(a) + len(b), {}
    rows = {-1: [worst] * (len(b) + 2), 0: [worst, *range(len(b) + 1)]}
    for i, x in enumerate(a, 1):
        last, row = 0, [worst, i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j + 1] = min(rows[i - 1][j] + (x != y), row[j] + 1, rows[i - 1][j + 1] + 1)
            if y in seen and last:
                k = seen[y]
                row[j + 1] = min(row[j + 1], rows[k - 1][last] + (i - k - 1) + 1 + (j - last - 1))
            if x == y:
                last = j
        rows[i] = row
        seen[x] = i
    return rows[len(a)][len(b) + 1]


def indel_of(a: str, b: str) -> float:
    """1 - (insertions and deletions) / (both lengths), by the longest common subsequence in bits; 0 where one is empty."""
    if not a or not b:
        return 0.0
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for y in b:
        u = s & places.get(y, 0)
        s = ((s + u) | (s - u)) & full
    common = len(a) - s.bit_count()
    return 2 * common / (len(a) + len(b))


def _paired(one, kind: str):
    @F.pandas_udf(kind)
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        known: dict = {}
        out = []
        for p in zip(a, b):
            if p not in known:
                known[p] = None if p[0] is None or p[1] is None else one(*p)
            out.append(known[p])
        return pd.Series(out, dtype="object")

    return run


def jaro_winkler(a: Column, b: Column) -> Column:
    return _paired(jaro_winkler_of, "double")(a, b)


def damerau(a: Column, b: Column) -> Column:
    return _paired(damerau_of, "int")(a, b)


def indel(a: Column, b: Column) -> Column:
    return _paired(indel_of, "double")(a, b)


def grams(c: Column, n: int = 3) -> Column:
    """Distinct runs of n characters; a shorter text is one, an empty text none."""
    s = F.trim(c)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.array_distinct(runs))


def gram_jaccard(a: Column, b: Column, n: int = 3) -> Column:
    """Share of common runs of n characters; 1 for two empty texts."""
    x, y = grams(a, n), grams(b, n)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(x, y)) / union)
