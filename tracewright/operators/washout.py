"""How fast the signal falls when it ends: the exponent of the standards' washouts, which decay despiking needs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import runs
from tracewright.operators.stats import r2

#: Rounds of the fit at most, and the relative step at which it rests.
ROUNDS, REST = 60, 1e-12


def scaled(value: str, over: Window) -> Column:
    """From 0, the least of the window, to 1, the largest."""
    lo, hi = F.min(value).over(over), F.max(value).over(over)
    return F.try_divide(F.col(value) - lo, hi - lo)


def tails(df: DataFrame, value: str = "total_counts", transition: str = "trn", time: str = "time", limit: float | None = None) -> DataFrame:
    """(sample, run, t, y): the falling part of every second transition, counted from a trace's last one back.

    Rows strictly between a transition's bounds are scaled and smoothed over
    three rows, beyond whose ends there is 0; the first has its neighbour's
    mean. The tail begins two rows after the place where falling by at least
    `limit`, half the largest fall by default, first starts or ends. It is
    scaled anew; its time counts from 0 in steps of the trace's second interval.
    """
    spans = runs.ranges(df, transition, time)
    last = Window.partitionBy("sample")
    spans = spans.withColumn("__last", F.max("run").over(last)).where("(__last - run) % 2 = 0").drop("__last")
    steps = df.groupBy("sample").agg((F.max(F.when(F.col("idx") == 2, F.col(time))) - F.max(F.when(F.col("idx") == 1, F.col(time)))).alias("step"))
    # A trace has a handful of transitions: its rows meet them by sample, not by time.
    rows = df.select("sample", "idx", F.col(time).alias("t"), F.col(value).alias("v")).join(spans, "sample").where("t > t_lo AND t < t_hi")
    one = Window.partitionBy("sample", "run")
    order = one.orderBy("idx")
    rows = rows.withColumn("n", F.row_number().over(order)).withColumn("v", scaled("v", one))
    near = lambda k: F.coalesce(F.lag("v", k).over(order) if k > 0 else F.lead("v", -k).over(order), F.lit(0.0))
    rows = rows.withColumn("m", (near(1) + F.col("v") + near(-1)) / 3)
    rows = rows.withColumn("m", F.when(F.col("n") == 1, F.coalesce(F.lead("m").over(order), F.col("m"))).otherwise(F.col("m")))
    rows = rows.withColumn("fall", F.col("m") - F.coalesce(F.lead("m").over(order), F.lit(0.0)))
    bound = F.lit(limit) if limit is not None else 0.5 * F.max("fall").over(one)
    rows = rows.withColumn("steep", F.col("fall") >= bound)
    # The last row is followed by the first.
    turn = F.col("steep") != F.coalesce(F.lead("steep").over(order), F.min_by("steep", "n").over(one))
    rows = rows.withColumn("turn", turn)
    first = F.min(F.when(F.col("turn"), F.col("n"))).over(one)
    rows = rows.withColumn("k", F.col("n") - first - 2).where("k >= 0")
    rows = rows.withColumn("y", scaled("v", one)).join(steps, "sample")
    return rows.select("sample", "run", F.round(F.col("k") * F.col("step"), 2).alias("t"), "y")


def exponent(tails: DataFrame, below: float = 0.0) -> dict[str, float]:
    """exponent, sd, r2 and used (exponent - below * sd) of y = exp(exponent * t) through the least y of each time; r2 is of all points.

    The fit is Gauss-Newton: each round is a sum over the times, whatever
    their number.
    """
    least = tails.where("y IS NOT NULL AND NOT isnan(y)").groupBy("t").agg(F.min("y").alias("y")).persist()
    try:
        n = least.count()
        if not n:
            raise ValueError("no washout to fit: there is no falling transition in the standards")
        e = -1.0
        for _ in range(ROUNDS):
            model = F.exp(F.lit(e) * F.col("t"))
            slope = F.col("t") * model
            top, bottom, rest = least.agg(F.sum(slope * (F.col("y") - model)), F.sum(slope * slope), F.sum((F.col("y") - model) ** 2)).first()
            step = top / bottom if bottom else 0.0
            e += max(-1.0, min(1.0, step))
            if abs(step) <= REST * max(1.0, abs(e)):
                break
    finally:
        least.unpersist()
    sd = math.sqrt(rest / (n - 1) / bottom) if n > 1 and bottom else float("nan")
    return {"exponent": e, "sd": sd, "r2": r2(tails, "y", F.exp(F.lit(e) * F.col("t"))), "used": e - below * sd if below else e}

