"""Tail probabilities that Spark has no function for, for whole batches at once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

log_gamma = np.vectorize(math.lgamma, otypes=[float])


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c, d = np.ones_like(y), 1 - (p + q) * y / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 300):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + step * d
            c = 1 + step / c
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    with np.errstate(divide="ignore"):
        front = np.exp(log_gamma(p + q) - log_gamma(p) - log_gamma(q) + p * np.log(y) + q * np.log1p(-y)) / p
    out = np.where(y <= 0, 0.0, front * h)
    return np.where(swap, 1 - out, out)


def p_of_t(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """Two-sided p of Student's t."""
    return incomplete_beta(np.asarray(df, float) / 2, np.full(np.shape(t), 0.5), np.asarray(df, float) / (np.asarray(df, float) + np.square(t)))


def two_sided_p(r: str, n: str) -> Column:
    """p of a correlation r of n pairs; null without r or with fewer than three pairs."""

    @F.pandas_udf("double")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for rs, ns in batches:
            ok = (rs.notna() & (ns > 2)).to_numpy()
            out = np.full(len(rs), np.nan)
            x, df = rs.to_numpy(float)[ok], ns.to_numpy(float)[ok] - 2
            out[ok] = p_of_t(x * np.sqrt(df / np.maximum(1 - x * x, 1e-300)), df)
            yield pd.Series(out).where(ok, None).astype("float64")

    return F.nanvl(of(F.col(r), F.col(n)), F.lit(None).cast("double"))
