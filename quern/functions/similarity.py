"""Jaro-Winkler similarity by code points, for which Spark has no built-in: an Arrow UDF, meant for blocked candidate pairs.

A batch is worked on as matrices of code points: one step for each character of the longer texts instead of one for each pair.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Cells of a batch's matrices.
CELLS = 1 << 20


def jaro_winkler_text(a: str, b: str) -> float:
    """Jaro similarity, always raised by a tenth of the rest for each of up to four common first characters."""
    return float(jaro_winkler_batch([a], [b])[0])


def _codes(texts: list[str], width: int, fill: int) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    out = np.full((len(texts), width), fill, np.int64)
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    out[np.arange(width) < sizes[:, None]] = flat
    return out, sizes


def jaro_winkler_batch(a: list[str], b: list[str]) -> np.ndarray:
    """The similarities of pairs of texts."""
    order = sorted(range(len(a)), key=lambda i: max(len(a[i]), len(b[i])))
    out, at = np.zeros(len(a)), 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * max(len(a[order[end]]), len(b[order[end]]), 1) <= CELLS:
            end += 1
        rows = order[at:end]
        out[rows] = _similar([a[i] for i in rows], [b[i] for i in rows])
        at = end
    return out


def _similar(a: list[str], b: list[str]) -> np.ndarray:
    wide = max(1, *map(len, a), *map(len, b))
    x, m = _codes(a, wide, -1)
    y, n = _codes(b, wide, -2)
    rows, place = np.arange(len(a)), np.arange(wide)
    reach = np.maximum(np.maximum(m, n) // 2 - 1, 0)
    mine, taken = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
    for i in range(int(m.max())):
        fits = (y == x[:, i, None]) & ~taken & (np.abs(place - i) <= reach[:, None])
        j = fits.argmax(1)
        hit = fits[rows, j]
        mine[hit, i] = True
        taken[rows[hit], j[hit]] = True
    common = mine.sum(1)
    # The common characters of either text in their order, side by side; those that differ are half transpositions.
    differ = np.bincount(np.nonzero(mine)[0], x[mine] != y[taken], len(a))
    safe = np.maximum(common, 1)
    jaro = np.where(common > 0, (common / np.maximum(m, 1) + common / np.maximum(n, 1) + (common - differ / 2) / safe) / 3, 0.0)
    jaro[(m == 0) & (n == 0)] = 1.0
    prefix = np.cumprod(x[:, :4] == y[:, :4], 1).sum(1)
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    some = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    out[some] = jaro_winkler_batch(a[some].tolist(), b[some].tolist())
    return pd.Series(out, dtype="float64").where(some, None)
