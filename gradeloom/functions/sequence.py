"""Ratcliff-Obershelp similarity of texts, with the popular characters that the standard library leaves out.

The longest common block of two texts is found in their matrix of equal characters, whose diagonal runs are counted once with array
operations; the parts before and after it are rectangles of the same matrix.  Characters that make up more than one
in a hundred of a second text of 200 or more start no block but prolong one.  Two upper bounds come first: the characters that
both texts have, and their lengths.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_column

#: Cells of a matrix worked on at a time: longer pairs of texts are scanned row by row.
CELLS = 1 << 22
#: From this length of the second text on, characters with more than 1 + length / POPULAR occurrences are popular.
LONG, POPULAR = 200, 100


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def starters(b: np.ndarray) -> np.ndarray:
    """Which characters of the second text can start a block."""
    if len(b) < LONG:
        return np.ones(len(b), bool)
    _, which, counts = np.unique(b, return_inverse=True, return_counts=True)
    return counts[which] <= len(b) // POPULAR + 1


class Pair:
    """Two texts and, if it isn't too large, the length of the run of equal characters that ends at each pair of places."""

    def __init__(self, a: np.ndarray, b: np.ndarray) -> None:
        self.a, self.b, self.starts = a, b, starters(b)
        self.runs = self.all_runs() if len(a) * (len(a) + len(b)) <= CELLS else None

    def all_runs(self) -> np.ndarray:
        n, m = len(self.a), len(self.b)
        wide = np.zeros((n, n + m), bool)
        wide[:, n:] = (self.a[:, None] == self.b[None, :]) & self.starts
        # Row i moved i places to the left: diagonals become columns.
        flat = np.zeros(n * (n + m + 1), bool)
        flat[: wide.size] = wide.reshape(-1)
        skew = flat.reshape(n, n + m + 1)
        line = np.arange(n, dtype=np.int32)[:, None]
        run = line - np.maximum.accumulate(np.where(skew, np.int32(-1), line), axis=0)
        return np.ascontiguousarray(run.reshape(-1)[: wide.size].reshape(n, n + m)[:, n:])

    def longest(self, alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
        """End places and length of the longest run inside a rectangle: of equal ones the first in the first text, then in the second."""
        width = np.arange(1, bhi - blo + 1, dtype=np.int32)
        if self.runs is not None:
            inside = np.minimum(self.runs[alo:ahi, blo:bhi], width)
            np.minimum(inside, np.arange(1, ahi - alo + 1, dtype=np.int32)[:, None], out=inside)
            at = int(inside.argmax())
            i, j = divmod(at, bhi - blo)
            return alo + i, blo + j, int(inside[i, j])
        best, run, b, starts = (alo, blo, 0), np.zeros(bhi - blo + 1, np.int32), self.b[blo:bhi], self.starts[blo:bhi]
        for i in range(alo, ahi):
            run[1:] = np.where((b == self.a[i]) & starts, run[:-1] + 1, 0)
            j = int(run.argmax())
            if run[j] > best[2]:
                best = i, blo + j - 1, int(run[j])
        return best

    def matches(self) -> int:
        """Characters in the blocks of all rectangles."""
        a, b, total, todo = self.a, self.b, 0, [(0, len(self.a), 0, len(self.b))]
        while todo:
            alo, ahi, blo, bhi = todo.pop()
            if alo >= ahi or blo >= bhi:
                continue
            i, j, size = self.longest(alo, ahi, blo, bhi)
            i, j = (i - size + 1, j - size + 1) if size else (alo, blo)
            while i > alo and j > blo and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < ahi and j + size < bhi and a[i + size] == b[j + size]:
                size += 1
            if size:
                total += size
                todo += [(alo, i, blo, j), (i + size, ahi, j + size, bhi)]
        return total


def of_pair(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two texts as code points; 1 for two empty ones."""
    if len(a) == len(b) and (a == b).all():
        return 1.0
    return 2.0 * Pair(a, b).matches() / (len(a) + len(b))


def best_of(texts: list[str], others: list[str]) -> np.ndarray:
    """The largest similarity of each text to any of the others, which come second; 0 without others.

    Pairs are taken by falling upper bound: twice the characters that both have, over all.  None is scored that can't be better.
    """
    mine, theirs = [points(t) for t in texts], [points(t) for t in others]
    if not theirs:
        return np.zeros(len(texts))
    alphabet = np.unique(np.concatenate([*mine, *theirs, np.empty(0, np.uint32)]))
    count = lambda x: np.bincount(np.searchsorted(alphabet, x), minlength=len(alphabet)).astype(np.int32)
    held, length = np.array([count(x) for x in theirs]), np.array([len(x) for x in theirs])
    out = np.zeros(len(texts))
    for i, a in enumerate(mine):
        both = len(a) + length
        bound = np.where(both > 0, 2.0 * np.minimum(held, count(a)).sum(axis=1) / np.maximum(both, 1), 1.0)
        for j in np.argsort(-bound, kind="stable"):
            if bound[j] <= out[i]:
                break
            out[i] = max(out[i], of_pair(a, theirs[j]))
    return out


def ratio(a: Column | str, b: Column | str) -> Column:
    """The similarity of two text columns; null if either is."""

    @F.pandas_udf("double")
    def apply(x: pd.Series, y: pd.Series) -> pd.Series:
        known = x.notna() & y.notna()
        out = pd.Series([None] * len(x), dtype="float64")
        out[known] = [of_pair(points(p), points(q)) for p, q in zip(x[known], y[known])]
        return out

    return apply(as_column(a), as_column(b))
