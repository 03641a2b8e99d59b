"""Backgrounds: summaries of background stretches, their course over time, and its subtraction."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.durable import durable
from tracewright.operators import blocks, ranked
from tracewright.operators.frames import IDX, SAMPLE


def summaries(df: DataFrame, values: list[str], stretch: str = "ns", time: str = "u_time", n_min: int = 20, n_max: int | None = None, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """For each stretch with more than n_min rows, and fewer than n_max: its size, mean time, and mean, sd (one degree of freedom less) and error of each value."""
    stats = [x for v in values for x in (F.avg(v).alias(f"{v}_mean"), F.stddev_samp(v).alias(f"{v}_std"), (F.stddev_pop(v) / F.sqrt(F.count(v))).alias(f"{v}_se"))]
    out = df.where(F.col(stretch) > 0).groupBy(*by, stretch).agg(F.count(F.lit(1)).alias("n"), F.avg(time).alias(time), *stats)
    return out.where((F.col("n") > n_min) & (F.col("n") < n_max if n_max is not None else F.lit(True)))


def rolling_outliers(means: DataFrame, values: list[str], win: int, n_lim: float, by: str = SAMPLE, time: str = "u_time") -> DataFrame:
    """Adds dropped: the trailing mean of win rows is over the previous row's trailing mean + n_lim * sd, for any value. A group's first row has its last one before it."""
    ordered = Window.partitionBy(by).orderBy(time)
    last = Window.partitionBy(by).orderBy(F.desc(time))
    frame = ordered.rowsBetween(-(win - 1), 0)
    out = F.lit(False)
    for v in values:
        enough = F.count(F.lit(1)).over(frame) == win
        means = means.withColumn(f"__m_{v}", F.when(enough, F.avg(v).over(frame))).withColumn(f"__l_{v}", F.col(f"__m_{v}") + n_lim * F.when(enough, F.stddev_samp(v).over(frame)))
        means = means.withColumn(f"__p_{v}", F.when(F.row_number().over(ordered) == 1, F.first(f"__l_{v}").over(last)).otherwise(F.lag(f"__l_{v}").over(ordered)))
        out = out | F.coalesce(F.col(f"__m_{v}") > F.col(f"__p_{v}"), F.lit(False))
    means = means.withColumn("dropped", out)
    return means.drop(*[f"__{x}_{v}" for x in "mlp" for v in values])


def grid(df: DataFrame, step: float, time: str = "u_time", by: str = SAMPLE) -> DataFrame:
    """(by, grid_time): evenly spaced times from 0 to each group's last one, floor(last / step) of them and at least two."""
    ends = df.groupBy(by).agg(F.max(time).alias("__end")).withColumn("__n", F.greatest(F.floor(F.col("__end") / step), F.lit(2)).cast("int"))
    at = F.transform(F.sequence(F.lit(0), F.col("__n") - 1), lambda i: F.col("__end") * i / (F.col("__n") - 1))
    return ends.select(by, F.explode(at).alias("grid_time"))


def weighted(points: DataFrame, at: DataFrame, values: list[str], fwhm: float, time: str = "u_time", by: str = SAMPLE, reach: float | None = 8.0) -> DataFrame:
    """Gaussian-weighted mean, sd and error of each value at each grid time.

    Points and grid times of a group meet by time cells as wide as `reach`
    standard deviations, so that a grid time sees its own cell and the two
    beside it, and rows grow with the points in reach, not with their product.
    What lies farther weighs under exp(-reach ** 2 / 2), in units of a point at
    the grid time itself. With reach None all points of a group count, each
    grid time against each: a product that only suits small groups.
    """
    sigma = fwhm / (2 * math.sqrt(2 * math.log(2)))
    if reach is None:
        met = at.join(points, by)
    else:
        cell = lambda t: F.floor(F.col(t) / (reach * sigma))
        near = at.withColumn("__cell", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: cell("grid_time") + d)))
        met = near.join(points.withColumn("__cell", cell(time)), [by, "__cell"])
    d = (F.col("grid_time") - F.col(time)) / sigma
    met = met.withColumn("__w", F.exp(-0.5 * d * d))
    w = F.col("__w")
    sums = [x for v in values for x in (F.sum(w * F.col(v)).alias(f"__s_{v}"), F.sum(w * F.col(v) * F.col(v)).alias(f"__q_{v}"), F.sum(F.when(F.col(v).isNotNull(), w)).alias(f"__w_{v}"))]
    out = met.groupBy(by, "grid_time").agg(*sums)
    for v in values:
        mean = F.try_divide(F.col(f"__s_{v}"), F.col(f"__w_{v}"))
        sd = F.sqrt(F.greatest(F.try_divide(F.col(f"__q_{v}"), F.col(f"__w_{v}")) - mean * mean, F.lit(0.0)))
        out = out.withColumn(f"{v}_mean", mean).withColumn(f"{v}_std", sd).withColumn(f"{v}_se", F.try_divide(sd, F.sqrt(f"__w_{v}")))
    return out.drop(*[f"__{x}_{v}" for x in "sqw" for v in values])


#: How a value is found between knots; beyond the first and the last it is constant.
KINDS = ("linear", "nearest", "previous", "next", "quadratic", "cubic")
#: Knots of a block that curves are solved in, and of its borders: what a knot says fades at every next one, by more than a half.
KNOTS, BORDER = 50_000, 64


def solved(t: np.ndarray, y: np.ndarray, kind: str, first: bool, last: bool) -> tuple[np.ndarray, np.ndarray]:
    """What a curve through the knots has at each: slope and half second derivative (quadratic, whose pieces part midway between knots), or 0 and the second derivative (cubic).

    One tridiagonal system for all columns of y. first and last tell whether
    these are the trace's own ends, where the two outermost pieces are one
    curve; else ends are free, for they are far from what is asked.
    """
    n, h = len(t), np.diff(t)
    rise = np.diff(y, axis=0) / h[:, None]
    if kind == "cubic":
        low, mid, high, right = np.zeros(n), np.ones(n), np.zeros(n), np.zeros(y.shape)
        low[1:-1], mid[1:-1], high[1:-1] = h[:-1], 2 * (h[:-1] + h[1:]), h[1:]
        right[1:-1] = 6 * np.diff(rise, axis=0)
        if first:  # the end's is on the line through the next two
            mid[1], high[1], low[1] = mid[1] + h[0] + h[0] ** 2 / h[1], high[1] - h[0] ** 2 / h[1], 0.0
        if last:
            mid[-2], low[-2], high[-2] = mid[-2] + h[-1] + h[-1] ** 2 / h[-2], low[-2] - h[-1] ** 2 / h[-2], 0.0
        m = tridiagonal(low, mid, high, right)
        if first:
            m[0] = m[1] - h[0] / h[1] * (m[2] - m[1])
        if last:
            m[-1] = m[-2] + h[-1] / h[-2] * (m[-2] - m[-3])
        return np.zeros(y.shape), m
    # Slopes d midway between knots; at a knot, and to the ends, the slope is on the line between those beside it.
    share = h[:-1] / (h[:-1] + h[1:])  # of the way from one middle to the next, at the knot between
    low, mid, high = np.zeros(n - 1), np.full(n - 1, 2.0), np.zeros(n - 1)
    mid[1:] += share
    low[1:] = 1 - share
    mid[:-1] += 1 - share
    high[:-1] = share
    out = lambda a, b: a / (a + b)  # from a middle to the end, in ways to the next middle
    if first:
        e = out(h[0], h[1])
        mid[0], high[0] = mid[0] + 1 + e, high[0] - e
    else:
        mid[0] += 1
    if last:
        e = out(h[-1], h[-2])
        mid[-1], low[-1] = mid[-1] + 1 + e, low[-1] - e
    else:
        mid[-1] += 1
    d = tridiagonal(low, mid, high, 4 * rise)
    half = np.diff(d, axis=0) / (h[:-1] + h[1:])[:, None]
    half = np.concatenate([half[:1], half, half[-1:]])
    slope = np.concatenate([d[:1] - half[:1] * h[0], d[:-1] + (d[1:] - d[:-1]) * share[:, None], d[-1:] + half[-1:] * h[-1]])
    return slope, half


def tridiagonal(low: np.ndarray, mid: np.ndarray, high: np.ndarray, right: np.ndarray) -> np.ndarray:
    """x of low[i] x[i - 1] + mid[i] x[i] + high[i] x[i + 1] = right[i], for each column."""
    n, c, x = len(mid), np.zeros(len(mid)), right.astype(float).copy()
    c[0], x[0] = high[0] / mid[0], x[0] / mid[0]
    for i in range(1, n):
        by = mid[i] - low[i] * c[i - 1]
        c[i], x[i] = high[i] / by, (x[i] - low[i] * x[i - 1]) / by
    for i in range(n - 2, -1, -1):
        x[i] -= c[i] * x[i + 1]
    return x


def curved(knots: DataFrame, values: list[str], kind: str, knot_time: str = "knot_time", by: str = SAMPLE, size: int | None = None) -> DataFrame:
    """knots with <value>__b and <value>__a, which a quadratic or cubic curve through them needs; knots of a group differ in time, and none of their values is null.

    A group's knots are dealt out in blocks with borders (operators/blocks) and
    solved there, so that no task holds them all. A cubic curve needs four
    knots, a quadratic one three: groups of fewer are an error.
    """
    least = 4 if kind == "cubic" else 3
    few = knots.groupBy(by).count().where(F.col("count") < least).first()
    if few:
        raise ValueError(f"a {kind} curve needs {least} knots; {few[0]!r} has {few[1]}")
    renamed = knots.withColumnRenamed(by, SAMPLE) if by != SAMPLE else knots
    placed = ranked.numbered(renamed, [SAMPLE, knot_time], "__place")
    firsts = placed.groupBy(SAMPLE).agg(F.min("__place").alias("__first"))
    rows = durable(placed.join(firsts, SAMPLE).withColumn(IDX, F.col("__place") - F.col("__first")).drop("__place", "__first"))
    dealt = blocks.blocked(rows, BORDER, size=size or KNOTS)
    added = [f"{v}__{x}" for v in values for x in "ba"]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(c, T.DoubleType()) for c in added]])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(IDX, kind="stable")
        b, a = solved(pdf[knot_time].to_numpy(float), pdf[values].to_numpy(float), kind, bool(pdf[IDX].iloc[0] == 0), bool(pdf[IDX].iloc[-1] == pdf[blocks.ROWS].iloc[0] - 1))
        for i, v in enumerate(values):
            pdf[f"{v}__b"], pdf[f"{v}__a"] = b[:, i], a[:, i]
        return pdf[pdf[blocks.OWN]][[f.name for f in schema]]

    out = dealt.groupBy(*blocks.BLOCKS).applyInPandas(solve, schema).drop(IDX)
    return out.withColumnRenamed(SAMPLE, by) if by != SAMPLE else out


def interpolated(df: DataFrame, knots: DataFrame, values: list[str], time: str = "u_time", knot_time: str = "knot_time", by: str = SAMPLE, kind: str = "linear") -> DataFrame:
    """Adds <value>_at for each value: between the group's knots by kind, constant beyond them. For a curve the knots are those of curved().

    Rows and knots are laid in one order of time, and each row takes the last
    knot before it and the first after, so there is no join by range. Midway
    between two, the earlier is the nearest.
    """
    if kind not in KINDS:
        raise ValueError(f"kind is one of {list(KINDS)}, not {kind!r}")
    names = [c for c in df.columns if c not in (by, time)]
    taken = [*values, *([f"{v}__{x}" for v in values for x in "ba"] if kind in ("quadratic", "cubic") else [])]
    k = F.struct(F.col(knot_time).alias("t"), *[F.col(v).alias(v) for v in taken])
    rows = df.select(F.col(by), F.col(time).alias("__t"), F.lit(1).alias("__kind"), F.struct(*(names or [F.lit(0).alias("__none")])).alias("__row"), F.lit(None).cast(knots.select(k.alias("k")).schema["k"].dataType).alias("__k"))
    marks = knots.select(F.col(by), F.col(knot_time).cast("double").alias("__t"), F.lit(0).alias("__kind"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), k.alias("__k"))
    both = rows.withColumn("__t", F.col("__t").cast("double")).unionByName(marks)
    forward = Window.partitionBy(by).orderBy("__t", "__kind").rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy(by).orderBy(F.desc("__t"), "__kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("__lo", F.last("__k", ignorenulls=True).over(forward)).withColumn("__hi", F.last("__k", ignorenulls=True).over(back)).where("__kind = 1")

    def at(v: str) -> Column:
        lo, hi, t = F.col("__lo"), F.col("__hi"), F.col("__t")
        wide, x, y = hi["t"] - lo["t"], t - lo["t"], hi["t"] - t
        if kind == "linear":
            between = lo[v] + (hi[v] - lo[v]) * (x / wide)
        elif kind == "quadratic":
            near = lambda k, way: k[v] + k[f"{v}__b"] * way + k[f"{v}__a"] * way * way
            between = F.when(x <= y, near(lo, x)).otherwise(near(hi, -y))
        elif kind == "cubic":
            bent = (lo[f"{v}__a"] * y * y * y + hi[f"{v}__a"] * x * x * x) / (6 * wide)
            between = bent + (lo[v] / wide - lo[f"{v}__a"] * wide / 6) * y + (hi[v] / wide - hi[f"{v}__a"] * wide / 6) * x
        else:
            between = {"previous": lo[v], "next": hi[v], "nearest": F.when(x <= y, lo[v]).otherwise(hi[v])}[kind]
        return F.when(lo.isNull(), hi[v]).when(hi.isNull() | (lo["t"] == hi["t"]), lo[v]).otherwise(between)

    return both.select(by, F.col("__t").alias(time), *[F.col("__row")[n].alias(n) for n in names], *[at(v).alias(f"{v}_at") for v in values])


def near_knots(df: DataFrame, knots: DataFrame, time: str = "u_time", knot_time: str = "knot_time") -> DataFrame:
    """(sample, knots' columns): for each sample the knots around its own times, so that each can be interpolated by itself.

    Knots of all samples are one sequence. Each stretch between two of them,
    and each sample, names the cells of time that it covers, as many in all as
    there are knots; both meet by cell.
    """
    names = [c for c in knots.columns if c != knot_time]
    lo, hi, n = knots.agg(F.min(knot_time), F.max(knot_time), F.count(F.lit(1))).first()
    if not n:
        return df.select("sample").limit(0).join(knots, F.lit(True))
    gap = (hi - lo) / n or 1.0
    cell = lambda t: F.least(F.greatest(F.floor((F.col(t) - lo) / gap), F.lit(0)), F.lit(n)).cast("int")
    ordered = Window.orderBy(knot_time)  # a row for each knot
    stretches = knots.withColumn("__to", F.coalesce(F.lead(knot_time).over(ordered), F.col(knot_time))).withColumn("__own", F.struct(knot_time, *names))
    stretches = stretches.withColumn("__next", F.coalesce(F.lead("__own").over(ordered), F.col("__own")))
    stretches = stretches.select(F.explode(F.sequence(cell(knot_time), cell("__to"))).alias("__cell"), "__own", "__next")
    spans = df.groupBy("sample").agg(F.min(time).alias("__lo"), F.max(time).alias("__hi")).where("__lo IS NOT NULL")
    spans = spans.select("sample", F.explode(F.sequence(cell("__lo"), cell("__hi"))).alias("__cell"))
    met = spans.join(stretches, "__cell").select("sample", F.explode(F.array("__own", "__next")).alias("k"))
    return met.select("sample", "k.*").distinct()


def subtracted(df: DataFrame, values: list[str], signal: str = "sig") -> DataFrame:
    """value - value_at within the signal, null elsewhere."""
    return df.withColumns({v: F.when(F.coalesce(F.col(signal), F.lit(False)), F.col(v) - F.col(f"{v}_at")) for v in values})
