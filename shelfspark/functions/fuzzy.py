"""Token-set similarity of two texts, 0 to 100."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one bit row for each character of b."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = (1 << len(a)) - 1
    mask = row
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & mask
    return len(a) - row.bit_count()


def indel_ratio(a: str, b: str) -> float:
    return 100.0 * 2 * _common(a, b) / (len(a) + len(b)) if a or b else 100.0


def token_set_ratio(a: str, b: str) -> float:
    """100 where one text's words hold the other's; else the best of the shared words against each side, and the two sides."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both, left, right = sorted(x & y), sorted(x - y), sorted(y - x)
    if both and (not left or not right):
        return 100.0
    base = " ".join(both)
    one, two = " ".join([base, *left] if base else left), " ".join([base, *right] if base else right)
    scores = [indel_ratio(one, two)]
    if base:
        scores += [indel_ratio(base, one), indel_ratio(base, two)]
    return max(scores)


def score(title: str | None, query: str | None) -> int:
    a, b = (query or "").strip().lower(), (title or "").strip().lower()
    return round(token_set_ratio(a, b)) if a and b else 0


@F.pandas_udf(T.IntegerType())  # a type object, as a type string would need a session when this is imported
def _scores(title: pd.Series, query: pd.Series) -> pd.Series:
    known: dict[tuple[str | None, str | None], int] = {}
    out = []
    for pair in zip(title, query, strict=True):
        if pair not in known:
            known[pair] = score(*pair)
        out.append(known[pair])
    return pd.Series(out, dtype="int32")


def match_score(title: Column, query: Column) -> Column:
    """The rounded token-set ratio of trimmed, lower-cased texts; 0 if either is empty."""
    return _scores(title, query)
