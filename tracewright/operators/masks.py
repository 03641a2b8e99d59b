"""Masks by threshold, percentile, gradient and correlation, and the language that combines them.

A mask is a boolean column f__<set>__<name>. A null value is in no mask of a
threshold, and passes a correlation filter.
"""

from __future__ import annotations

import difflib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.student import two_sided_p
from tracewright.operators import blocks, frames
from tracewright.operators.frames import SAMPLE, whole
from tracewright.operators.ranked import quantiles


def sure(predicate: Column) -> Column:
    return F.coalesce(predicate, F.lit(False))


def threshold(value: str | Column, limit: float | Column) -> tuple[Column, Column]:
    """Below, and above or equal."""
    v = F.col(value) if isinstance(value, str) else value
    return sure(v < limit), sure(v >= limit)


def zero_screened(df: DataFrame, values: list[str]) -> DataFrame:
    """All values null in rows where any is 0 or less, or null."""
    good = sure(F.greatest(*[F.when(F.col(v) > 0, 0).otherwise(1) for v in values], F.lit(0)) == 0)
    return df.withColumns({v: F.when(good, F.col(v)) for v in values})


def percentile_masks(df: DataFrame, value: str, percentiles: list[float], level: str = "population", mask: Column | None = None) -> DataFrame:
    """Adds below and above for one percentile, inside (closed) and outside for two.

    Limits interpolate linearly. Those of the population are of the rows that
    `mask` holds for and are found when this is called; those of each sample are
    of all its rows. The masks cover all rows.
    """
    at = [F.lit(float(p) / 100) for p in percentiles]
    if level == "population":
        taken = df if mask is None else df.where(mask)
        limits = quantiles(taken, value, [float(p) / 100 for p in percentiles])
        df = df.withColumn("__limits", F.array(*[F.lit(x).cast("double") for x in limits]))
    elif level == "individual":
        df = df.withColumn("__limits", F.percentile(value, F.array(*at)).over(whole()))
    else:
        raise ValueError(f"level is population or individual, not {level!r}")
    v, lo, hi = F.col(value), F.col("__limits")[0], F.col("__limits")[len(at) - 1]
    if len(at) == 1:
        below, above = threshold(value, lo)
        return df.withColumn("below", below).withColumn("above", above).drop("__limits")
    return df.withColumn("inside", sure(v.between(lo, hi))).withColumn("outside", sure((v < lo) | (v > hi))).drop("__limits")


def gradient_masks(df: DataFrame, value: str, win: int, limit: float, mode: str = "mid", absolute: bool = True, exclude_outside: bool = False, block: int | None = None) -> DataFrame:
    """Adds gradient, below and above. Rows without a full frame take the nearest one's gradient, or are in no mask if they are to be excluded. With block, traces go in blocks of so many rows."""
    df = blocks.with_gradient(df, value, win, mode, size=block) if block else frames.with_gradient(df, value, win, mode)
    g = F.abs("gradient") if absolute else F.col("gradient")
    if exclude_outside:
        g = F.when(frames.full(*frames.reach(win, mode)), g)
    below, above = threshold(g, limit)
    return df.withColumn("below", below).withColumn("above", above)


def correlation_mask(df: DataFrame, x: str, y: str, window: int, r_threshold: float = 0.9, p_threshold: float = 0.05, block: int | None = None) -> DataFrame:
    """Adds r, p and kept: not (|r| over its threshold and p under its own). Without r a row is kept."""
    if block:
        df = blocks.correlation(df, x, y, window, size=block).withColumnRenamed("pairs", "__pairs")
    else:
        r, pairs = frames.correlation(x, y, window)
        df = df.withColumn("r", r).withColumn("__pairs", pairs)
    df = df.withColumn("p", two_sided_p("r", "__pairs")).drop("__pairs")
    return df.withColumn("kept", ~sure((F.abs("r") > r_threshold) & (F.col("p") < p_threshold)))


def accounting(df: DataFrame, signal: str, kept: str | Column) -> DataFrame:
    """(sample, n_signal, n_kept, removed_percent)."""
    signal, kept = sure(F.col(signal)), sure(F.col(kept) if isinstance(kept, str) else kept)
    n, k = F.count_if(signal), F.count_if(signal & kept)
    return df.groupBy(SAMPLE).agg(n.alias("n_signal"), k.alias("n_kept"), F.try_divide(100.0 * (n - k), n).alias("removed_percent"))


def best_match(key: str, names: list[str]) -> str:
    """The name most like key; the first of those that are equally so."""
    if not names:
        raise ValueError("there are no filters to match")
    return max(names, key=lambda n: difflib.SequenceMatcher(None, key, n).ratio())


def column_of(name: str) -> str:
    return "f__" + name.replace(":", "__", 1)


def combined(key: str, names: list[str]) -> Column:
    """A mask from an expression of filter names, "&", "|" and brackets; "&" binds closer. Names are matched by likeness; an empty key is all true.

    Every name becomes a quoted column and the operators SQL's own, so that
    Spark's parser reads the expression and nothing is evaluated here.
    """
    if not key.strip():
        return F.lit(True)
    word = re.compile(r"[^()|& ]+")
    sql = word.sub(lambda m: f"coalesce(`{column_of(best_match(m[0], names))}`, false)", key.replace("`", ""))
    return F.expr(sql.replace("&", " AND ").replace("|", " OR "))


class Switches:
    """Which filters are on for which values. Filters start off; set numbers rise."""

    def __init__(self, values: list[str]):
        self.values = list(values)
        self.on_: dict[str, set[str]] = {}
        self.sets = 0

    @property
    def names(self) -> list[str]:
        return list(self.on_)

    def next_set(self) -> int:
        self.sets += 1
        return self.sets - 1

    def add(self, name: str, setn: int | None = None) -> str:
        n = self.next_set() if setn is None else setn
        self.on_[full := f"{n}:{name}"] = set()
        return full

    def _which(self, filt: None | int | str | list, multi: str = "best") -> list[str]:
        if filt is None:
            return self.names
        if isinstance(filt, list):
            return [x for f in filt for x in self._which(f, multi)]
        if isinstance(filt, int):
            return [n for n in self.names if n.split(":")[0] == str(filt)]
        if multi == "substring":
            return [n for n in self.names if filt in n]
        return [filt] if filt in self.on_ else [best_match(filt, self.names)]

    def turn(self, on: bool, filt=None, values: list[str] | None = None, multi: str = "best") -> None:
        for n in self._which(filt, multi):
            (self.on_[n].update if on else self.on_[n].difference_update)(self.values if values is None else values)

    def clear(self) -> None:
        self.on_, self.sets = {}, 0

    def status(self, spark) -> DataFrame:
        rows = [(n, v, v in on) for n, on in self.on_.items() for v in self.values]
        return spark.createDataFrame(rows, "filter string, value string, is_on boolean")

    def mask(self, filt: bool | str | dict, value: str | None = None) -> Column:
        """True: what is on for the value, or without a value what is on for any. A string is an expression, a dict has one for each value."""
        if isinstance(filt, dict):
            filt = filt.get(value, False)
        if isinstance(filt, str):
            return combined(filt, self.names)
        out = F.lit(True)
        for n, on in self.on_.items() if filt else ():
            if (value in on) if value is not None else bool(on):
                out = out & sure(F.col(column_of(n)))
        return out
