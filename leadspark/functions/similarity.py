"""String similarity that Spark lacks, as Arrow UDFs on pairs or groups that a join has blocked."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def jaro_winkler_value(a: str, b: str) -> float:
    """Jaro with a bonus of 0.1 for each of up to four equal first characters; equal texts 1, one empty 0."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    free = [True] * len(b)
    mine: list[str] = []
    for i, ch in enumerate(a):
        j = next((j for j in range(max(0, i - reach), min(len(b), i + reach + 1)) if free[j] and b[j] == ch), None)
        if j is not None:
            free[j] = False
            mine.append(ch)
    m = len(mine)
    if not m:
        return 0.0
    theirs = [ch for j, ch in enumerate(b) if not free[j]]
    swaps = sum(x != y for x, y in zip(mine, theirs, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    same = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4], strict=False)) if x != y), min(4, len(a), len(b)))
    return jaro + same * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_value(x or "", y or "") for x, y in zip(a, b, strict=True)], dtype="float64")


def similar_pairs(x: list[str], y: list[str] | None, threshold: float, few: int = 64, rows: int = 256):
    """(i, j, similarity) of all pairs of x[i] and y[j] (or x[i] and x[j], i < j, without y) that reach threshold.

    With l equal first characters Jaro must reach (threshold - l/10) / (1 - l/10), and of texts of a and b characters
    m / a + m / b must reach three times that, less one. Texts share as many characters as their bags with numbered
    repetitions have in common: products of 0/1 matrices give this bound for blocks of pairs, and only what it leaves is
    compared. Up to `few` pairs are compared at once.
    """
    alone = y is None
    y = x if y is None else y
    if len(x) * len(y) <= few:
        pairs = [(i, j) for i in range(len(x)) for j in range(i + 1 if alone else 0, len(y))]
    else:
        ids: dict[tuple[str, int], int] = {}
        bags = []
        for text in (*x, *([] if alone else y)):
            seen: dict[str, int] = {}
            bag = []
            for c in text:
                seen[c] = seen.get(c, 0) + 1
                bag.append(ids.setdefault((c, seen[c]), len(ids)))
            bags.append(bag)
        table = np.zeros((len(bags), max(len(ids), 1)), np.float32)
        for i, bag in enumerate(bags):
            table[i, bag] = 1
        first = np.array([[ord(c) for c in t[:4].ljust(4, "\0")] for t in (*x, *([] if alone else y))]).reshape(-1, 4)
        n = np.array([len(t) for t in (*x, *([] if alone else y))], np.float64)
        right = slice(0, len(x)) if alone else slice(len(x), None)
        pairs = []
        for at in range(0, len(x), rows):
            left = slice(at, min(at + rows, len(x)))
            common = table[left] @ table[right].T
            same = np.cumprod((first[left, None] == first[None, right]) & (first[left, None] > 0), 2).sum(2) / 10
            a, b = n[left, None], n[None, right]
            least = (3 * (threshold - same) / (1 - same) - 1) * a * b / np.maximum(a + b, 1)
            i, j = np.nonzero(common >= least - 1e-6)
            pairs += [(int(p) + at, int(q)) for p, q in zip(i, j, strict=True) if not alone or p + at < q]
    return [(i, j, s) for i, j in pairs if (s := jaro_winkler_value(x[i], y[j])) >= threshold]
