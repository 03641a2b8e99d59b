"""Statistics of samples and ablations, and comparisons of two measurements."""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.durable import durable
from tracewright.functions.student import two_sided_p
from tracewright.operators import merging
from tracewright.operators.frames import SAMPLE
from tracewright.operators.ranked import quantiles, ranged, running
from tracewright.operators.robust import huber_of_groups


def huber(values: np.ndarray) -> tuple[float, float]:
    """Mean and deviation of Huber's proposal: values are drawn in to mean +- 1.5 deviations until none is beyond; the deviation is 1.134 times that of the drawn-in values.

    Drawing in again and again leaves the values cut at a low and a high bound,
    so a round only moves these two, and finds its sums in those of the sorted
    values, which run from the median outwards.
    """
    x = np.asarray(values, float)
    x = np.sort(x[np.isfinite(x)])
    n = len(x)
    if not n:
        return np.nan, np.nan
    centre, m = x[n // 2], n // 2
    x = x - centre
    sums, squares = ([*(-np.cumsum(y[:m][::-1])[::-1]).tolist(), 0.0, *np.cumsum(y[m:]).tolist()] for y in (x, x * x))
    x = x.tolist()
    low, high = x[0], x[-1]

    def moments() -> tuple[float, float]:
        i, j = bisect_left(x, low), bisect_right(x, high)
        mean = (i * low + sums[j] - sums[i] + (n - j) * high) / n
        square = (i * low * low + squares[j] - squares[i] + (n - j) * high * high) / n
        return mean, 1.134 * math.sqrt(max(square - mean * mean, 0.0))

    mean, sd = moments()
    for _ in range(1000):
        lo, hi = mean - 1.5 * sd, mean + 1.5 * sd
        if low >= lo and high <= hi:
            break
        low, high = min(max(low, lo), hi), min(max(high, lo), hi)
        mean, sd = moments()
    return float(mean + centre), float(sd)


BUILT_IN: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "se": lambda x: F.stddev_pop(x) / F.sqrt(F.count(x)),
    "n": lambda x: F.count(x).cast("double"),
}
BUILT_IN |= {"nanmean": BUILT_IN["mean"], "nanstd": BUILT_IN["std"], "stderr": BUILT_IN["se"]}
ROBUST = ("H15_mean", "H15_std", "H15_se")
#: Rows of a group that are held as an array at most, but for callables.
WHOLE = 200_000


def of_arrays(stats: list[str | Callable]):
    """Robust statistics and callables of arrays, all in one pass over them: one struct for each array."""

    def name(s: str | Callable) -> str:
        return s if isinstance(s, str) else s.__name__

    @F.pandas_udf(T.StructType([T.StructField(name(s), T.DoubleType()) for s in stats]))
    def found(arrays: pd.Series) -> pd.DataFrame:
        rows = []
        for x in arrays:
            x = np.asarray(x, float)
            x = x[~np.isnan(x)]
            mean, sd = huber(x) if any(isinstance(s, str) for s in stats) else (np.nan, np.nan)
            known = {"H15_mean": mean, "H15_std": sd, "H15_se": sd / np.sqrt(len(x)) if len(x) else np.nan}
            rows.append([known[s] if isinstance(s, str) else float(s(x)) for s in stats])
        return pd.DataFrame(rows, columns=[name(s) for s in stats])

    return found


def sample_stats(df: DataFrame, values: list[str], stats: list[str | Callable] = ("mean", "std"), masks: dict[str, Column] | None = None, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """<value>_<stat> for each group; each value has a mask of its own, by default all rows. Unknown names are an error; a callable takes an array and has its own name.

    The built-in ones combine before the shuffle. Robust ones, and callables,
    take the values of a group of up to WHOLE rows together, as an array of
    numbers, in the same pass. Groups of more are told apart first, and their
    robust statistics are sums by cells (operators/robust): the same numbers.
    Only a callable needs the array of such a group. A name that is registered
    in operators/merging has states that merge.
    """
    masks = masks or {}
    if own := {s: merging.STATISTICS[s] for s in stats if isinstance(s, str) and s in merging.STATISTICS}:
        rest = sample_stats(df, values, [s for s in stats if s not in own] or ["n"], masks, by)
        found = merging.merged(df, values, own, masks, by).withColumnsRenamed({c: f"__m_{c}" for c in by})
        met = rest.join(found, [F.col(c).eqNullSafe(F.col(f"__m_{c}")) for c in by], "left")
        return met.select(*by, *[f"{v}_{s if isinstance(s, str) else s.__name__}" for v in values for s in stats])
    if any(s in ROBUST for s in stats if isinstance(s, str)):
        large = df.groupBy(*by).count().where(F.col("count") > WHOLE).select(*by)
        if not large.isEmpty():
            return _with_large(df, values, list(stats), masks, by, durable(large))
    return _grouped(df, values, stats, masks, by)


def _with_large(df: DataFrame, values: list[str], stats: list[str | Callable], masks: dict[str, Column], by: tuple[str, ...], large: DataFrame) -> DataFrame:
    """sample_stats where some groups are large: those are named by a row each."""
    named = large.select(*[F.col(c).alias(f"__g_{c}") for c in by])
    on = [F.col(c).eqNullSafe(F.col(f"__g_{c}")) for c in by]
    few, many = df.join(named, on, "left_anti"), df.join(named, on, "left_semi")
    plain = [s for s in stats if callable(s) or s not in ROBUST]
    out = _grouped(many, values, [*plain, "n"] if "n" not in plain else plain, masks, by)
    for v in values:
        x = F.when(F.coalesce(masks[v], F.lit(False)), F.col(v)) if v in masks else F.col(v)
        found = huber_of_groups(many.select(*by, x.alias("__v")), list(by), "__v").select(*[F.col(c).alias(f"__h_{c}") for c in by], F.col("mean").alias(f"{v}_H15_mean"), F.col("sd").alias(f"{v}_H15_std"), (F.col("sd") / F.sqrt("n")).alias(f"{v}_H15_se"))
        out = out.join(found, [F.col(c).eqNullSafe(F.col(f"__h_{c}")) for c in by], "left").drop(*[f"__h_{c}" for c in by])
    names = [f"{v}_{s if isinstance(s, str) else s.__name__}" for v in values for s in stats]
    return _grouped(few, values, stats, masks, by).unionByName(out.select(*by, *names))


def _grouped(df: DataFrame, values: list[str], stats: list[str | Callable], masks: dict[str, Column], by: tuple[str, ...]) -> DataFrame:
    arrays = [s for s in stats if callable(s) or s in ROBUST]
    if unknown := [s for s in stats if s not in arrays and s not in BUILT_IN]:
        raise ValueError(f"unknown statistic {unknown[0]!r}; known are {[*BUILT_IN, *ROBUST]} and callables")
    found, out = [], []
    for v in values:
        x = F.when(F.coalesce(masks[v], F.lit(False)), F.col(v)) if v in masks else F.col(v)
        found += [BUILT_IN[s](x).alias(f"{v}_{s}") for s in stats if s not in arrays]
        found += [F.collect_list(x.cast("double")).alias(f"__a_{v}")] if arrays else []
        out += [F.col(f"__r_{v}")[s if isinstance(s, str) else s.__name__].alias(f"{v}_{s if isinstance(s, str) else s.__name__}") if s in arrays else F.col(f"{v}_{s}") for s in stats]
    grouped = df.groupBy(*by).agg(*found)
    if arrays:
        of = of_arrays(arrays)
        grouped = grouped.withColumns({f"__r_{v}": of(F.col(f"__a_{v}")) for v in values})
    return grouped.select(*by, *out)


def filter_effect(df: DataFrame, values: list[str], mask: Column, by: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """Mean and deviation with the mask, without it, and their ratios, in one pass."""
    out = df.groupBy(*by).agg(*[f(F.when(m, F.col(v))).alias(f"{v}_{s}_{tag}") for v in values for s, f in (("mean", F.avg), ("std", F.stddev_pop)) for tag, m in (("filtered", F.coalesce(mask, F.lit(False))), ("all", F.lit(True)))])
    return out.withColumns({f"{v}_{s}_ratio": F.try_divide(F.col(f"{v}_{s}_filtered"), F.col(f"{v}_{s}_all")) for v in values for s in ("mean", "std")})


def ablation_times(df: DataFrame, ablation: str = "ns", time: str = "time") -> DataFrame:
    """(sample, rep, seconds): the duration of each ablation; rep counts from 0."""
    return df.where(F.col(ablation) > 0).groupBy(SAMPLE, (F.col(ablation) - 1).alias("rep")).agg((F.max(time) - F.min(time)).alias("seconds"))


def long_stats(wide: DataFrame, values: list[str], stats: list[str], keys: tuple[str, ...] = (SAMPLE,)) -> DataFrame:
    """(statistic, keys, values): one row for each statistic, one column for each value."""
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(s).alias("statistic"), *[F.col(f"{v}_{s}").alias(v) for v in values]) for s in stats])).alias("x")).select("x.statistic", *keys, *[f"x.{v}" for v in values])


def bins(df: DataFrame, value: str, n: int, by: tuple[str, ...] = ()) -> DataFrame:
    """(bin, lo, hi, n) of equal widths between the least and the largest value; the last bin is closed. A single value is one bin."""
    lim = df.groupBy(*by).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    both = df.join(lim, list(by)) if by else df.join(F.broadcast(lim))  # without groups: one row
    width = (F.col("__hi") - F.col("__lo")) / n
    at = F.coalesce(F.least(F.floor(F.try_divide(F.col(value) - F.col("__lo"), width)), F.lit(n - 1)), F.lit(0)).cast("int")
    out = both.where(F.col(value).isNotNull()).groupBy(*by, at.alias("bin"), "__lo", "__hi").agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, "bin", (F.col("__lo") + F.col("bin") * width).alias("lo"), (F.col("__lo") + (F.col("bin") + 1) * width).alias("hi"), "n")


def pair_differences(df: DataFrame, group: str, rep: str, value: str) -> DataFrame:
    """(group, rep_a, rep_b, difference) for each pair of a group's repetitions: repetitions of one sample, a handful each."""
    a, b = (df.select(group, F.col(rep).alias(f"rep_{x}"), F.col(value).alias(f"__{x}")) for x in "ab")
    return a.join(b, group).where("rep_a < rep_b").select(group, "rep_a", "rep_b", F.abs(F.col("__a") - F.col("__b")).alias("difference"))


def half_cauchy_scale(x: np.ndarray) -> float:
    """Maximum-likelihood scale of a half Cauchy distribution at 0, by bisection of its score."""
    x = np.asarray(x, float)
    x = x[x > 0]
    if not len(x):
        return np.nan
    lo, hi = np.log(x.min()) - 1, np.log(x.max()) + 1
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (2 * x**2 / (x**2 + np.exp(2 * mid))).sum() > len(x) else (lo, mid)
    return float(np.exp((lo + hi) / 2))


#: Candidate scales of a pass, and passes: the logarithm's bracket shrinks by CANDIDATES + 1 in each.
CANDIDATES, PASSES = 31, 10


def half_cauchy_fit(df: DataFrame, value: str) -> float:
    """half_cauchy_scale of a column: each pass aggregates the score at a grid of candidate scales and keeps the cell where it changes sign."""
    x = df.select(F.col(value).cast("double").alias("x")).where("x > 0 AND NOT isnan(x)").persist()
    try:
        n, least, most = x.agg(F.count(F.lit(1)), F.min("x"), F.max("x")).first()
        if not n:
            return float("nan")
        lo, hi = np.log(least) - 1, np.log(most) + 1
        x2 = F.col("x") * F.col("x")
        for _ in range(PASSES):
            grid = np.linspace(lo, hi, CANDIDATES + 2)
            score = x.agg(*[F.sum(2 * x2 / (x2 + F.lit(float(np.exp(2 * t))))) for t in grid[1:-1]]).first()
            k = sum(v > n for v in score)
            lo, hi = grid[k], grid[k + 1]
    finally:
        x.unpersist()
    return float(np.exp((lo + hi) / 2))


def reproducibility(differences: DataFrame, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """Half-Cauchy quantiles of the differences. The fit runs when this is called, in passes of sums."""
    scale = half_cauchy_fit(differences, "difference")
    one = differences.sparkSession.range(1).select(F.lit(scale).alias("scale"))
    return one.select("scale", *[(F.col("scale") * F.tan(F.lit(np.pi * q / 2))).alias(f"q{round(100 * q)}") for q in quantiles])


def residual_summary(df: DataFrame, x: str, y: str) -> DataFrame:
    """N, quartiles of y - x, and the line of residuals on x, with the two-sided p of its slope."""
    r = (F.col(y) - F.col(x)).alias("r")
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(x).alias("x"), r)
    lq, median, uq = (F.lit(v).cast("double") for v in quantiles(p, "r", [0.25, 0.5, 0.75]))
    out = p.agg(F.count(F.lit(1)).alias("n"), F.regr_slope("r", "x").alias("slope"), F.regr_intercept("r", "x").alias("intercept"), F.regr_r2("r", "x").alias("r2"), F.corr("r", "x").alias("__r"))
    return out.withColumn("slope_p", two_sided_p("__r", "n")).select("n", median.alias("median"), lq.alias("lq"), uq.alias("uq"), (uq - lq).alias("iqr"), "slope", "slope_p", "intercept", "r2")


def kolmogorov_p(distance: Column, n: Column, m: Column) -> Column:
    """How likely so large a distance is of samples of n and m from one distribution, by Kolmogorov's limit."""
    x2 = distance * distance * n * m / (n + m)
    term = lambda s, k: s + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * x2)
    # At so small a distance the series is slow, and 1 to twelve digits.
    return F.when(x2 < 0.04, 1.0).otherwise(F.least(F.greatest(F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term), F.lit(0.0)), F.lit(1.0)))


def r2(df: DataFrame, measured: str, model: Column, force_zero: bool = False) -> float | None:
    """1 - residual / total sum of squares; the total is about zero with force_zero, else about the mean."""
    y = F.col(measured)
    # The sum about the mean is as many times the variance as there are values.
    total = F.sum(y * y) if force_zero else F.var_pop(y) * F.count(y)
    return df.agg((1 - F.try_divide(F.sum((y - model) * (y - model)), total)).alias("r2")).first()[0]


def ks_statistic(df: DataFrame, value: str, side: str, first, by: str | None = None) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov distance of value where side is `first` and where it isn't, and its p for large samples.

    Equal values are counted together first, so the running sums go over
    distinct values: those of a group, or, without groups, in ranges.
    """
    keys = [by] if by else []
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("v")).agg(F.count_if(F.col(side) == first).alias("a"), F.count_if(F.col(side) != first).alias("b"))
    if not by:
        sums = running(ranged(counts, "v"), "v", {"fa": "a", "fb": "b"})
        return sums.join(F.broadcast(counts.agg(F.sum("a").alias("na"), F.sum("b").alias("nb")))).agg(F.max(F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb"))).alias("ks"), kolmogorov_p(F.max(F.abs(F.col("fa") / F.col("na") - F.col("fb") / F.col("nb"))), F.max("na"), F.max("nb")).alias("ks_p"))  # sums: one row
    base = Window.partitionBy(by)
    run = base.orderBy("v")
    d = F.abs(F.sum("a").over(run) / F.sum("a").over(base) - F.sum("b").over(run) / F.sum("b").over(base))
    n = counts.withColumn("d", d).groupBy(*keys).agg(F.max("d").alias("ks"), F.sum("a").alias("__na"), F.sum("b").alias("__nb"))
    return n.select(*keys, "ks", kolmogorov_p(F.col("ks"), F.col("__na"), F.col("__nb")).alias("ks_p"))


def bland_altman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds pair_mean and residual to each pair, and the residuals' median and 2.5 and 97.5 percentiles."""
    p = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumn("pair_mean", (F.col(x) + F.col(y)) / 2).withColumn("residual", F.col(y) - F.col(x))
    low, middle, high = (F.lit(v).cast("double") for v in quantiles(p, "residual", [0.025, 0.5, 0.975]))
    return p.withColumns({"low": low, "middle": middle, "high": high})


def root_sum_squares(x: Column) -> Column:
    return F.sqrt(F.sum(x * x))
