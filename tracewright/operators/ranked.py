"""Order over a whole table, in ranges: running sums and exact quantiles without one task that holds it all.

Splitters, a range's count and a quantile's value come to the driver, as many
numbers as there are ranges; so these functions run when they are called.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.durable import durable

RANGE = "__range"


def n_ranges(df: DataFrame) -> int:
    return max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def ranged(df: DataFrame, by: str, n: int | None = None) -> DataFrame:
    """Adds __range: rows in ranges of `by`, numbered in its order, of about equal size where values differ; null first, NaN last. Equal values share a range."""
    n = n or n_ranges(df)
    double = F.col(by).cast("double")
    found = df.select(double.alias("v")).where("v IS NOT NULL AND NOT isnan(v)").approxQuantile("v", [i / n for i in range(1, n)], 1 / (4 * n))
    splits = [-math.inf, *sorted({x for x in found if math.isfinite(x)}), math.inf]
    if len(splits) == 2:
        splits.insert(1, 0.0)
    cut = Bucketizer(splits=splits, inputCol="__by", outputCol=RANGE, handleInvalid="keep")
    return cut.transform(df.withColumn("__by", double)).withColumn(RANGE, F.when(F.col("__by").isNull(), -1).otherwise(F.col(RANGE).cast("int"))).drop("__by")


def running(df: DataFrame, by: str, values: dict[str, str], before: bool = False) -> DataFrame:
    """Adds name: the running sum of each value of a ranged table in order of `by`, whose rows differ, up to the row itself or to the one before.

    A range is summed within itself; what the ranges before it add is joined, a
    row for each range.
    """
    of = Window.partitionBy(RANGE).orderBy(by).rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    earlier = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(RANGE).agg(*[F.sum(v).alias(name) for name, v in values.items()])
    starts = totals.select(RANGE, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(f"__0_{name}") for name in values])
    out = df.withColumns({f"__1_{name}": F.coalesce(F.sum(v).over(of), F.lit(0)) for name, v in values.items()}).join(F.broadcast(starts), RANGE)
    return out.withColumns({name: F.col(f"__0_{name}") + F.col(f"__1_{name}") for name in values}).drop(*[f"__{i}_{name}" for i in "01" for name in values])


def quantiles(df: DataFrame, value: str, at: list[float], n: int | None = None) -> list[float | None]:
    """Exact quantiles, between ranks linear, of the values that aren't null; None of no values.

    Rows are counted by range, and only the ranges that hold a wanted rank are
    put in order.
    """
    x = ranged(df.select(F.col(value).cast("double").alias("v")).where("v IS NOT NULL"), "v", n)
    sizes = sorted((r[RANGE], r["count"]) for r in x.groupBy(RANGE).count().collect())
    total = sum(c for _, c in sizes)
    if not total:
        return [None for _ in at]
    places = [(total - 1) * q for q in at]
    wanted: dict[int, list[int]] = {}
    for rank in sorted({f(p) for p in places for f in (math.floor, math.ceil)}):
        first = 0
        for cell, count in sizes:
            if rank < first + count:
                wanted.setdefault(cell, []).append(rank - first)
                break
            first += count
    starts = {cell: sum(c for k, c in sizes if k < cell) for cell in wanted}
    upto = F.sum("n").over(Window.partitionBy(RANGE).orderBy("v"))
    cells = x.where(F.col(RANGE).isin([*wanted])).groupBy(RANGE, "v").agg(F.count(F.lit(1)).alias("n")).withColumn("upto", upto)
    ranks = [(cell, k) for cell, ks in wanted.items() for k in ks]
    found = cells.agg(*[F.min(F.when((F.col(RANGE) == cell) & (F.col("upto") > k), F.col("v"))).alias(f"r{i}") for i, (cell, k) in enumerate(ranks)]).first()
    value_of = {starts[cell] + k: found[i] for i, (cell, k) in enumerate(ranks)}
    out = []
    for p in places:
        lo, hi = math.floor(p), math.ceil(p)
        a, b = value_of[lo], value_of[hi]
        out.append(a if lo == hi or a == b else (hi - p) * a + (p - lo) * b)
    return out


def numbered(df: DataFrame, order: list[str | Column], name: str = "idx") -> DataFrame:
    """Adds each row's number, from 0, in an order of the whole table: ranges are sorted, and each is numbered from where those before it end. Equal rows are numbered as they come."""
    at = F.monotonically_increasing_id()  # the range, and the row in it
    placed = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", at)).withColumn(RANGE, F.shiftright("__at", 33).cast("int"))
    counts = placed.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n"))
    first = F.coalesce(F.sum("n").over(Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    row = F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(counts.select(RANGE, first.alias("__first"))), RANGE).withColumn(name, row).drop("__at", "__first", RANGE)
