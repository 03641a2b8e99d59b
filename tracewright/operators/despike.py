"""Spikes in counted signals."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.operators.frames import IDX, TRACE, odd, order, rolled, size, whole


def noise(df: DataFrame, values: list[str], win: int = 3, nlim: float = 24.0, maxiter: int = 4, of: tuple[str, ...] = TRACE) -> DataFrame:
    """Replaces values over mean + nlim * sqrt(mean) of the frame around them by that mean, maxiter times.

    Rows without a full frame stay; so do frames with a negative mean. A pass
    that changes nothing leaves the rest without effect, so the passes are laid
    out; all values share the window of a pass.
    """
    for _ in range(maxiter):
        means = {f"__mean_{v}": rolled(F.avg(v), odd(win), of=of) for v in values}
        df = df.withColumns(means)
        over = lambda v: (F.col(f"__mean_{v}") >= 0) & (F.col(v) > F.col(f"__mean_{v}") + nlim * F.sqrt(F.greatest(F.col(f"__mean_{v}"), F.lit(0.0))))
        df = df.withColumns({v: F.when(over(v), F.col(f"__mean_{v}")).otherwise(F.col(v)) for v in values}).drop(*means)
    return df


#: Rows at a trace's beginning from which the noise is told.
LEADING = (5, 10, 20, 30, 50)


def start(value: str) -> dict[str, Column]:
    """What decay() asks of a whole trace, as aggregates: the deviations of its leading values, and the first one."""
    leading = {f"__sd{k}_{value}": F.stddev_pop(F.when(F.col(IDX) < k, F.col(value))) for k in LEADING}
    return leading | {f"__first_{value}": F.max(F.when(F.col(IDX) == 0, F.col(value)))}


def decay(df: DataFrame, value: str, exponent: float, step: float, maxiter: int = 3, of: tuple[str, ...] = TRACE) -> DataFrame:
    """Replaces points that fall or rise faster than exp(exponent * t) allows by the one before.

    The noise is the deviation of the first 5 values, or of the first 10, 20,
    30 or 50, each in turn taken where it is under 1.5 times the noise so far;
    thrice that is the tolerance. Row 0 stays, and the last row's next is row 0.
    """
    if of == TRACE:
        df = df.withColumns({name: x.over(whole()) for name, x in start(value).items()})
    df = df.withColumn("__noise", F.col(f"__sd{LEADING[0]}_{value}"))
    for k in LEADING[1:]:
        sd = F.col(f"__sd{k}_{value}")
        df = df.withColumn("__noise", F.when(sd < 1.5 * F.col("__noise"), sd).otherwise(F.col("__noise")))
    df = df.withColumn("__limit", 3 * F.col("__noise")).withColumn("__n", size(of))
    down, up = math.exp(step * exponent), math.exp(-step * exponent)
    for _ in range(maxiter):
        after = F.when(F.col(IDX) == F.col("__n") - 1, F.col(f"__first_{value}")).otherwise(F.lead(value).over(order(of)))
        df = df.withColumn("__before", F.lag(value).over(order(of))).withColumn("__after", after)
        v, before, after, limit = (F.col(c) for c in (value, "__before", "__after", "__limit"))
        low = (v < before * down - limit) & (v < after - limit)
        high = (v > after * up + limit) & (v > before + limit)
        df = df.withColumn(value, F.when((F.col(IDX) > 0) & (low | high), before).otherwise(v))
    return df.drop("__noise", "__limit", "__n", "__before", "__after", *start(value))


def despiked(df: DataFrame, values: list[str], exponent: float | None = None, step: float = 1.0, win: int = 3, nlim: float = 12.0, maxiter: int = 4, total: str = "total_counts", of: tuple[str, ...] = TRACE) -> DataFrame:
    """Decay despiking where an exponent is given, then noise despiking, then the total anew."""
    if exponent is not None:
        for v in values:
            df = decay(df, v, exponent, step, maxiter, of)
    df = noise(df, values, win, nlim, maxiter, of)
    return df.withColumn(total, sum((F.coalesce(F.col(v), F.lit(0.0)) for v in values), F.lit(0.0)))
