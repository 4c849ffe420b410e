"""Scores between names and between vectors."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def contains_score(name: Column, q: str) -> Column:
    """0.7 for how the lower-cased name holds ``q`` (equal 1, front .8, end .6, inside .4) + 0.3 for like lengths; null if it doesn't."""
    nm, q = F.lower(name), q.lower()
    base = F.when(nm == q, 1.0).when(nm.startswith(q), 0.8).when(nm.endswith(q), 0.6).otherwise(0.4)
    n = F.length(nm)
    like = F.when(n == 0, 0.0).otherwise(1.0 - F.abs(n - len(q)) / F.greatest(n, F.lit(len(q))).cast("double"))
    return F.when(nm.contains(q), base * 0.7 + like * 0.3)


def plain(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def token_jaccard(a: Column, b: Column) -> Column:
    """Shared distinct tokens of two canonical names over all of them."""
    x, y = (F.array_distinct(F.filter(F.split(c, " "), lambda t: t != "")) for c in (a, b))
    union = F.size(F.array_union(x, y))
    return F.when(union > 0, F.size(F.array_intersect(x, y)) / union.cast("double")).otherwise(0.0)


def lexical_score(query: Column, name: Column) -> Column:
    """Token Jaccard plus .15 if one holds the other, .20 if at its front; at most 1."""
    q, c = plain(query), plain(name)
    bonus = F.when(c.startswith(q) | q.startswith(c), 0.20).when(c.contains(q) | q.contains(c), 0.15).otherwise(0.0)
    return F.when((q == "") | (c == ""), 0.0).otherwise(F.least(F.lit(1.0), token_jaccard(q, c) + bonus))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null for null or zero vectors."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


def as_index_score(cos: Column) -> Column:
    """Cosine on the scale of a vector index, 0 to 1."""
    return (1 + cos) / 2


def jaro_winkler_of(a: str | None, b: str | None) -> float:
    """Window max(len) / 2 - 1, prefix of up to 4 weighing .1, no floor under the prefix bonus."""
    a, b = (a or "").strip(), (b or "").strip()
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free, mine = [True] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == ch:
                free[j] = False
                mine.append(ch)
                break
    if not mine:
        return 0.0
    other = [ch for ch, f in zip(b, free, strict=True) if not f]
    swaps = sum(x != y for x, y in zip(mine, other, strict=True)) / 2
    m = len(mine)
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    front = next((k for k in range(min(4, len(a), len(b))) if a[k] != b[k]), min(4, len(a), len(b)))
    return jaro + front * 0.1 * (1 - jaro)


def _batch(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)])


def jaro_winkler(a: Column, b: Column) -> Column:
    """Arrow-batched, as Spark has no built-in; apply it behind the cheap filters."""
    return F.pandas_udf(_batch, "double")(a, b)


def letters(name: Column) -> Column:
    """The name's letters as tokens: a letter with how often it stood before, so that shared tokens count shared letters."""
    chars = F.split(F.trim(name), "")
    plain = F.filter(chars, lambda c: c != "")
    return F.transform(plain, lambda c, i: F.concat(c, F.size(F.filter(F.slice(plain, 1, i), lambda d: d == c)).cast("string")))
