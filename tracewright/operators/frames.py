"""Rolling operators over a trace: rows of a sample in order of idx.

A frame that would reach over an end of the trace is not full; each operator
states what such rows get. All is window expressions with one partitioning, so
several of them on one trace share its sort. `of` is what a window's rows have
in common: the trace, or a block of it (operators/blocks).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SAMPLE, IDX, TIME = "sample", "idx", "time"
#: A trace; a block of one, whose rows have the number of the trace's rows with them.
TRACE, BLOCKS, ROWS = (SAMPLE,), (SAMPLE, "__block"), "__rows"


def whole(of: tuple[str, ...] = TRACE) -> Window:
    return Window.partitionBy(*of)


def order(of: tuple[str, ...] = TRACE) -> Window:
    return Window.partitionBy(*of).orderBy(IDX)


def odd(win: int) -> int:
    return win + 1 - win % 2


def reach(win: int, mode: str = "mid") -> tuple[int, int]:
    """Rows before and after that a frame of win rows takes."""
    if mode == "mid":
        return (win // 2, win // 2) if win % 2 else (win // 2 - 1, win // 2)
    if mode == "left":
        return 0, win - 1
    if mode == "right":
        return win - 1, 0
    raise ValueError(f"mode is mid, left or right, not {mode!r}")


def size(of: tuple[str, ...] = TRACE) -> Column:
    """Rows of the trace."""
    return F.count(F.lit(1)).over(whole()) if of == TRACE else F.col(ROWS)


def full(before: int, after: int, of: tuple[str, ...] = TRACE) -> Column:
    return (F.col(IDX) >= before) & (F.col(IDX) < size(of) - after)


def rolled(expr: Column, win: int, mode: str = "mid", of: tuple[str, ...] = TRACE) -> Column:
    """An aggregate over each full frame; null elsewhere."""
    before, after = reach(win, mode)
    return F.when(full(before, after, of), expr.over(order(of).rowsBetween(-before, after)))


def clamped(df: DataFrame, name: str, expr: Column, win: int, mode: str = "mid", of: tuple[str, ...] = TRACE) -> DataFrame:
    """Adds an aggregate over each frame; rows without a full one repeat the first or last that has."""
    before, after = reach(win, mode)
    df = df.withColumn(name, rolled(expr, win, mode, of)).withColumn("__n", size(of))
    first = F.max(F.when(F.col(IDX) == before, F.col(name))).over(whole(of))
    last = F.max(F.when(F.col(IDX) == F.col("__n") - 1 - after, F.col(name))).over(whole(of))
    return df.withColumn(name, F.when(F.col(IDX) < before, first).when(F.col(IDX) >= F.col("__n") - after, last).otherwise(F.col(name))).drop("__n")


def smoothed(value: str, win: int, of: tuple[str, ...] = TRACE) -> Column:
    """Moving mean that lags by one row: row i has the mean of i - h - 1 to i + h - 1, h = win // 2. The first h + 1 rows have the mean of these, the last h - 1 too."""
    h = odd(win) // 2
    n = size(of)
    head = F.avg(F.when(F.col(IDX) <= h, F.col(value))).over(whole(of))
    tail = F.avg(F.when(F.col(IDX) >= n - (h - 1), F.col(value))).over(whole(of))
    mean = F.avg(value).over(order(of).rowsBetween(-(h + 1), h - 1))
    return F.when(F.col(IDX) <= h, head).when(F.col(IDX) >= n - (h - 1), tail).otherwise(mean)


def gradient_by_row(value: str, win: int, of: tuple[str, ...] = TRACE) -> Column:
    """Slope against the row number, 0 where the frame isn't full."""
    return F.coalesce(rolled(F.regr_slope(F.col(value), F.col(IDX)), odd(win), of=of), F.lit(0.0))


def with_gradient(df: DataFrame, value: str, win: int, mode: str = "mid", name: str = "gradient", time: str = TIME, of: tuple[str, ...] = TRACE) -> DataFrame:
    """Slope against time of frames with more than two values; the ends repeat the nearest full frame."""
    fit = F.regr_slope(F.col(value), F.col(time))
    pairs = F.count(F.when(F.col(value).isNotNull() & F.col(time).isNotNull(), 1))
    df = clamped(clamped(df, "__pairs", pairs, win, mode, of), name, fit, win, mode, of)
    return df.withColumn(name, F.when(F.col("__pairs") > 2, F.col(name))).drop("__pairs")


def correlation(x: str, y: str, win: int, of: tuple[str, ...] = TRACE) -> tuple[Column, Column]:
    """Pearson's r of each full, odd-sized frame with half of its pairs at least, and the number of pairs; null elsewhere, and where a side is constant."""
    win = odd(win)
    pairs = rolled(F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)), win, of=of)
    # Not corr(), which fails where a side is constant.
    apart = lambda a, b: rolled(F.stddev_pop(F.when(F.col(b).isNotNull(), F.col(a))), win, of=of)
    r = F.try_divide(rolled(F.covar_pop(x, y), win, of=of), apart(x, y) * apart(y, x))
    return F.when(pairs >= win // 2, r), pairs


def local_minima(value: str) -> Column:
    """True where both neighbours are larger."""
    return F.coalesce((F.col(value) < F.lag(value).over(order())) & (F.col(value) < F.lead(value).over(order())), F.lit(False))


def window_statistics(df: DataFrame, value: str, least: int, most: int | None = None) -> DataFrame:
    """(sample, w, centre, mean, sd) for every frame size w from least to most rows, by default to a row less than the sample has, and every centre where it is full.

    Frames of different sizes are one pass: prefix sums are joined with
    themselves w rows on, so a row is made for each frame and none is scanned
    again. sd has one degree of freedom less.
    """
    c = F.avg(value).over(whole())  # centred, so that sums of squares keep their digits
    sums = df.withColumn("__v", F.col(value) - c).withColumn("__c", c)
    run = order().rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.select(SAMPLE, IDX, "__c", F.sum("__v").over(run).alias("s"), F.sum(F.col("__v") * F.col("__v")).over(run).alias("q"), size().alias("n"))
    # The frames that end in a row: no larger than what lies up to it.
    last = F.least(F.col(IDX) + 1, F.col("n") - 1, F.lit(most))
    sizes = F.when(last >= least, F.sequence(F.lit(least), last.cast("int")))
    ends = sums.select(SAMPLE, "__c", F.col(IDX).alias("hi"), "s", "q", "n", F.explode(sizes).alias("w")).withColumn("lo", F.col("hi") - F.col("w"))
    starts = sums.select(SAMPLE, F.col(IDX).alias("lo"), F.col("s").alias("s0"), F.col("q").alias("q0"))
    both = ends.join(starts, [SAMPLE, "lo"], "left").na.fill(0.0, ["s0", "q0"])
    s, q, w = F.col("s") - F.col("s0"), F.col("q") - F.col("q0"), F.col("w")
    centre = F.col("lo") + 1 + F.when(w % 2 == 1, F.floor(w / 2)).otherwise(F.floor(w / 2) - 1)
    return both.select(SAMPLE, "w", centre.cast("int").alias("centre"), (s / w + F.col("__c")).alias("mean"), F.sqrt(F.greatest(q - s * s / w, F.lit(0.0)) / (w - 1)).alias("sd"))
