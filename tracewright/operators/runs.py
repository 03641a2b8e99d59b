"""Runs of a mask along a trace, and what is made of them.

A run is bounded by the last row before it (row 0 if it starts there) and its
last row. Masks that are null count as false.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.frames import IDX, SAMPLE, TIME, order, size, whole


def true(mask: str | Column) -> Column:
    return F.coalesce(F.col(mask) if isinstance(mask, str) else mask, F.lit(False))


def transitions(mask: str) -> Column:
    """True on each row whose next one differs."""
    return F.coalesce(F.lead(true(mask)).over(order()) != true(mask), F.lit(False))


def number(df: DataFrame, mask: str, name: str = "run", start: int = 1) -> DataFrame:
    """Adds the number of the row's run of true, counted in each sample; 0 outside runs."""
    begins = true(mask) & ~F.coalesce(F.lag(true(mask)).over(order()), F.lit(False))
    df = df.withColumn("__begins", begins.cast("int"))
    n = F.sum("__begins").over(order().rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn(name, F.when(true(mask), (n + (start - 1)).cast("int")).otherwise(0)).drop("__begins")


def enumerated(df: DataFrame, mask: str, name: str = "ns") -> DataFrame:
    """Numbers the runs with the row before each; the trace's last row has none."""
    df = number(df, mask, "__run")
    ahead = F.coalesce(F.lead("__run").over(order()), F.lit(0))
    own = F.when(F.col("__run") > 0, F.col("__run")).otherwise(ahead)
    return df.withColumn(name, F.when(F.col(IDX) == size() - 1, 0).otherwise(own)).drop("__run")


def bounds(df: DataFrame, mask: str) -> DataFrame:
    """(sample, run, start, stop): the rows that bound each run."""
    return number(df, mask).where("run > 0").groupBy(SAMPLE, "run").agg(F.greatest(F.min(IDX) - 1, F.lit(0)).cast("int").alias("start"), F.max(IDX).cast("int").alias("stop"))


def ranges(df: DataFrame, mask: str, time: str = TIME) -> DataFrame:
    """(sample, run, t_lo, t_hi): the times of the bounding rows."""
    before = df.withColumn("__before", F.coalesce(F.lag(time).over(order()), F.col(time)))
    return number(before, mask).where("run > 0").groupBy(SAMPLE, "run").agg(F.min_by("__before", IDX).alias("t_lo"), F.max_by(time, IDX).alias("t_hi"))


def inside(points: DataFrame, spans: DataFrame, time: str = TIME) -> DataFrame:
    """Adds inside: whether a point lies strictly within a span (sample, t_lo, t_hi) of its sample. Spans of a sample meet its points in one array."""
    of = spans.groupBy(SAMPLE).agg(F.collect_list(F.struct("t_lo", "t_hi")).alias("__spans"))
    hit = F.exists("__spans", lambda s: (F.col(time) > s["t_lo"]) & (F.col(time) < s["t_hi"]))
    return points.join(of, SAMPLE, "left").withColumn("inside", F.coalesce(hit, F.lit(False))).drop("__spans")


def _lengths(df: DataFrame, mask: str) -> DataFrame:
    """Adds the run number of every stretch of equal values, and its length; one that starts at row 0 counts one less."""
    change = F.coalesce((true(mask) != F.lag(true(mask)).over(order())).cast("int"), F.lit(0))
    df = df.withColumn("__change", change).withColumn("__stretch", F.sum("__change").over(order().rowsBetween(Window.unboundedPreceding, 0)))
    n = F.count(F.lit(1)).over(Window.partitionBy(SAMPLE, "__stretch"))
    return df.withColumn("__length", n - (F.col("__stretch") == 0).cast("int")).drop("__change")


def defragmented(df: DataFrame, mask: str, threshold: int = 3, mode: str = "include", name: str = "defrag") -> DataFrame:
    """Turns stretches of up to threshold rows: false ones to true (include) or true ones to false (exclude). Row 0 never turns; a trace without true stays."""
    if mode not in ("include", "exclude"):
        raise ValueError(f"mode is include or exclude, not {mode!r}")
    other = mode == "include"
    turn = (true(mask) != F.lit(other)) & (F.col("__length") <= threshold) & (F.col(IDX) > 0)
    has = F.max(true(mask).cast("int")).over(whole()) == 1
    return _lengths(df, mask).withColumn(name, F.when(turn & has, F.lit(other)).otherwise(true(mask))).drop("__stretch", "__length")


def without_downhole(df: DataFrame, mask: str, threshold: int = 2, name: str = "kept") -> DataFrame:
    """Excludes all from the row before the second excluded stretch of threshold rows at least; a trace with fewer of them stays."""
    df = _lengths(df, mask).withColumn("__out", ~true(mask) & (F.col("__length") >= threshold))
    first = F.min(F.when(F.col("__out"), F.col("__stretch"))).over(whole())
    df = df.withColumn("__limit", F.when(F.col("__out") & (F.col("__stretch") > first), F.greatest(F.col(IDX) - 1, F.lit(0))))
    limit = F.min("__limit").over(whole())
    return df.withColumn(name, true(mask) & ~F.coalesce(F.col(IDX) >= limit, F.lit(False))).drop("__stretch", "__length", "__out", "__limit")


def trimmed(df: DataFrame, mask: str, start: int = 1, end: int = 0, name: str = "trimmed") -> DataFrame:
    """True where the rows start before and end after are; both go round the ends of the trace."""
    df = df.withColumn("__m", true(mask)).withColumn("__n", size())

    def rolled(k: int) -> Column:
        """The mask k rows before; what has no such row takes it from the other end."""
        out = F.lag("__m", k).over(order()) if k > 0 else F.lead("__m", -k).over(order())
        for j in range(abs(k)):
            here, there = (F.lit(j), F.col("__n") - k + j) if k > 0 else (F.col("__n") - 1 - j, F.lit(-k - 1 - j))
            out = F.when(F.col(IDX) == here, F.max(F.when(F.col(IDX) == F.pmod(there, F.col("__n")), F.col("__m"))).over(whole())).otherwise(out)
        return out if k else F.col("__m")

    return df.withColumn(name, rolled(start) & rolled(-end)).drop("__m", "__n")
