"""Huber's mean and deviation of groups of any size, all groups at once and none in one task.

Drawing values in again and again leaves them cut at a low and a high bound, so
a round needs a group's sums below, between and above two bounds. Rows are
summed by cells: a group's range of values in CELLS parts, each with its
number, sums, smallest and largest value. On its cells a group's rounds run to
their end in no time; only cells that a bound cuts on its way are not exact, and
their rows alone are read again, in CELLS parts of the cell, until every bound
lies between two values. What is shuffled is cells.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.durable import durable, release

CELLS, ROUNDS = 4096, 1000
SUMS = ("n", "s", "q", "lo", "hi")


def drawn_in(cells: pd.DataFrame) -> tuple[float, float, np.ndarray]:
    """(mean, deviation, cut) of cells about a centre; a cell that a bound cuts counts as all at its mean, and is marked."""
    n, s, q, lo, hi = (cells[c].to_numpy(float) for c in SUMS)
    mid, total = s / n, n.sum()
    low, high, cut = lo.min(), hi.max(), np.zeros(len(n), bool)

    def moments() -> tuple[float, float]:
        cut[:] |= ((lo < low) & (hi > low)) | ((lo < high) & (hi > high))
        under, over = (hi <= low) | ((lo < low) & (mid < low)), (lo >= high) | ((hi > high) & (mid > high))
        inside = ~(under | over)
        below, above = n[under].sum(), n[over & ~under].sum()
        mean = (below * low + s[inside].sum() + above * high) / total
        square = (below * low * low + q[inside].sum() + above * high * high) / total
        return mean, 1.134 * math.sqrt(max(square - mean * mean, 0.0))

    mean, sd = moments()
    for _ in range(ROUNDS):
        a, b = mean - 1.5 * sd, mean + 1.5 * sd
        if low >= a and high <= b:
            break
        low, high = min(max(low, a), b), min(max(high, a), b)
        mean, sd = moments()
    return mean, sd, cut


def huber_of_groups(rows: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by ..., mean, sd, n) of each group's values that aren't null or NaN.

    Sums are about a value near the median, so that far values don't cost the
    others their digits.
    """
    rows = durable(rows.select(*by, F.col(value).cast("double").alias("__x")).where("__x IS NOT NULL AND NOT isnan(__x)"))
    ends = durable(rows.groupBy(*by).agg(F.percentile_approx("__x", 0.5, 1000).alias("__c"), F.min("__x").alias("__a"), F.max("__x").alias("__b")))
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in by]

    def cells_of(found: DataFrame) -> DataFrame:
        """found has rows with __c, and the ends __a and __b of what is cut."""
        part = F.least(F.floor(F.try_divide((F.col("__x") - F.col("__a")) * CELLS, F.col("__b") - F.col("__a"))), F.lit(CELLS - 1))
        x = F.col("__x") - F.col("__c")
        grouped = found.groupBy(*by, "__c", "__a", F.coalesce(part, F.lit(0)).alias("__part"))
        return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi")).drop("__a", "__part")

    def joined(of: DataFrame, *more) -> DataFrame:
        on = same("r", "e") + list(more)
        return rows.alias("r").join(of.alias("e"), on).select("r.*", *[f"e.{c}" for c in ("__c", "__a", "__b")])

    cells = durable(cells_of(joined(ends)))
    keys = [f for f in cells.schema.fields if f.name in by]
    schema = T.StructType([*keys, *[T.StructField(c, T.DoubleType()) for c in ("mean", "sd", "n", "__c", "__a", "__b")]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """A row with the result, and one more for each cell that a bound cuts (its ends)."""
        pdf = pdf.sort_values("lo", kind="stable")
        mean, sd, open_ = drawn_in(pdf)
        c, cut = float(pdf["__c"].iloc[0]), pdf[open_]
        key = [pdf[k].iloc[0] for k in by]
        out = [(*key, mean + c, sd, float(pdf["n"].sum()), c, np.nan, np.nan)]
        out += [(*key, np.nan, np.nan, np.nan, c, lo, hi) for lo, hi in zip(cut["lo"], cut["hi"], strict=True)]
        return pd.DataFrame(out, columns=[f.name for f in schema])

    while True:
        found = durable(cells.groupBy(*by).applyInPandas(run, schema))
        open_ = durable(found.where("mean IS NULL OR isnan(mean)").select(*by, "__c", F.col("__a").alias("lo"), F.col("__b").alias("hi")))
        if open_.isEmpty():
            break
        # The rows of the open cells, by their values about the centre, in finer cells instead.
        span = open_.select(*by, "__c", (F.col("lo") + F.col("__c")).alias("__a"), (F.col("hi") + F.col("__c")).alias("__b"), "lo", "hi")
        about = F.col("r.__x") - F.col("e.__c")
        finer = cells_of(joined(span, about >= F.col("e.lo"), about <= F.col("e.hi")))
        rest = cells.alias("r").join(open_.alias("e"), [*same("r", "e"), F.col("r.lo") == F.col("e.lo"), F.col("r.hi") == F.col("e.hi")], "left_anti")
        old, cells = cells, durable(rest.unionByName(finer))
        release(old, found, open_)
    return found.where("NOT isnan(mean)").select(*by, "mean", "sd", "n")
