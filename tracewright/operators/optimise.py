"""The best window of an ablation: the longest whose values are low (or high) and steady, told from all windows.

Rows that are null or NaN in any channel take no part: the others are one
series, as if those weren't there. Of every window, of every length from the
least to one row less than the series has, there are the mean, scaled among
the windows of its length, and the relative deviation, each averaged over the
channels. Thresholds are typical values of all windows' means and deviations.

Windows are made length by length from prefix sums and never kept. Up to EXACT
of them, an ablation's are put into order whole. Of a longer series they are
counted by the leading bits of the number (2 ** -12 of its size) with the sum of
what each count stands for, so that memory stays bounded and thresholds are
good to a few parts in ten thousand; such a series is dealt out by lengths, in
pieces of about PIECE windows: once to count them, once to choose. A function
as a mode sees all windows, and so takes series of up to EXACT of them.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.durable import durable

#: Each mode, and after it those that are tried where none of the windows is under (over) what it gives.
MODES = ("kde_first_max", "kde_max", "median", "bayes_mvs", "mean")
SCALERS = ("median", "bayes", "standard")
#: Windows of a series that are kept at once at most; and of a piece of a longer one, about.
EXACT, PIECE = 1 << 22, 1 << 24
#: Numbers that are counted at once, and their bits that a count leaves out.
HELD, REST = 1 << 21, 40
RESULT = "n_rows int, first {idx}, last {idx}, n_points int, centre {idx}, mean_threshold double, std_threshold double, mode string, message string"


def bayes_sd(x: np.ndarray) -> np.ndarray:
    """Each column's expected deviation under a flat prior; the plain one over 1000 values."""
    n, sd = len(x), x.std(axis=0)
    if n > 1000:
        return sd
    if n < 3:
        return np.full(x.shape[1], np.inf)
    return sd * math.sqrt(n / 2) * math.exp(math.lgamma((n - 2) / 2) - math.lgamma((n - 1) / 2))


def scaled(x: np.ndarray, by: str) -> np.ndarray:
    """Columns about 0 in units of their spread; not a number where they have none, or too few rows."""
    if len(x) < (3 if by == "median" else 2):
        return np.full(x.shape, np.nan)
    if by == "median":
        low, mid, high = quantiles(np.sort(x, axis=0), None, [0.25, 0.5, 0.75])
        return (x - mid) / np.where(high > low, high - low, np.nan)
    spread = bayes_sd(x) if by == "bayes" else x.std(axis=0)
    return (x - x.mean(axis=0)) / np.where(spread > 0, spread, np.nan)


def before(w: int) -> int:
    """Rows of a window of w before its centre."""
    return w // 2 if w % 2 else w // 2 - 1


def running(v: np.ndarray, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, means, deviations) of all windows of each length; a window's rows are added in turn, as SQL's aggregates add them, so that nothing outside it rounds its mean."""
    s, m, q = v[:0], v[:0], v[:0]
    for w in range(1, lengths.stop):
        x = v[w - 1 :]
        s = s[:-1] + x if w > 1 else x
        d = x - m[:-1] if w > 1 else x
        m = m[:-1] + d / w if w > 1 else x
        q = q[:-1] + d * (x - m) if w > 1 else np.zeros(x.shape)
        if w in lengths:
            yield w, s / w, np.sqrt(q / (w - 1))


def summed(v: np.ndarray, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The same from prefix sums, which begin at any length."""
    c = v.mean(axis=0)  # centred, so that sums of squares keep their digits
    zero = np.zeros((1, v.shape[1]))
    s, q = (np.concatenate([zero, np.cumsum(x, axis=0)]) for x in (v - c, (v - c) ** 2))
    for w in lengths:
        m = (s[w:] - s[:-w]) / w
        yield w, m + c, np.sqrt(np.maximum(q[w:] - q[:-w] - w * m * m, 0) / (w - 1))


def cells(v: np.ndarray, lengths: range, least: int, weights: np.ndarray, bias: float, scaler: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, means, relative deviations) of all windows of each length, in order of their first row; v has a column for each channel.

    With a bias over 0 both are multiplied by 1 - bias at the first centre of
    all to 1 + bias at the last.
    """
    tilt = np.linspace(1 - bias, 1 + bias, len(v) - least + 1) if bias > 0 else None
    for w, mean, sd in (running if n_windows(len(v), least) <= EXACT else summed)(v, lengths):
        with np.errstate(all="ignore"):
            a, b = (scaled(mean, scaler) * weights).mean(axis=1), (sd / np.abs(mean) * weights).mean(axis=1)
        if tilt is not None:
            at = before(w) - before(least)
            a, b = a * tilt[at : at + len(a)], b * tilt[at : at + len(a)]
        yield w, a, b


def n_windows(n: int, least: int, upto: int | None = None) -> int:
    """Windows of a series of n rows, of lengths from least on, below upto or n."""
    m = max(0, (n if upto is None else min(upto, n)) - least)
    return m * (n - least + 1) - m * (m - 1) // 2


class Counts:
    """Numbers, counted by their leading bits."""

    def __init__(self):
        self.held, self.n = [], 0
        self.found = pd.DataFrame({"bin": np.zeros(0, np.int64), "n": np.zeros(0, np.int64), "total": np.zeros(0)})

    def add(self, x: np.ndarray) -> None:
        self.held.append(x)
        self.n += len(x)
        if self.n >= HELD:
            self.settle()

    def settle(self) -> pd.DataFrame:
        x = np.concatenate([*self.held, np.zeros(0)]) + 0.0  # no negative zero
        new = pd.DataFrame({"bin": x.view(np.int64) >> REST, "n": 1, "total": x})
        self.held, self.n = [], 0
        self.found = pd.concat([self.found, new]).groupby("bin", as_index=False, sort=False).sum()
        return self.found


def quantiles(x: np.ndarray, n: np.ndarray | None, at: list[float]) -> list:
    """Of values x, in order, that occur n times each (once, if that is None); between ranks linear."""
    upto = None if n is None else np.cumsum(n)
    total = len(x) if n is None else int(upto[-1])
    out = []
    for q in at:
        rank = q * (total - 1)
        i, j = math.floor(rank), math.ceil(rank)
        lo, hi = (x[k] if n is None else x[np.searchsorted(upto, k, side="right")] for k in (i, j))
        out.append(lo + (hi - lo) * (rank - i))
    return out


def level(x: np.ndarray, mode: str | Callable, n: np.ndarray | None = None) -> float:
    """A typical one of values x, in order, that occur n times each. A density without a first maximum has its highest, one without a spread its median."""
    if callable(mode):
        return float(mode(x))
    if mode not in MODES:
        raise ValueError(f"mode is one of {list(MODES)}, a function or a pair of thresholds, not {mode!r}")
    total = len(x) if n is None else int(n.sum())
    times = 1 if n is None else n
    mean = float((x * times).sum() / total)
    if mode in ("mean", "bayes_mvs"):
        return mean
    if mode.startswith("kde") and total > 2:
        width = math.sqrt(float((times * (x - mean) ** 2).sum()) / (total - 1)) * total**-0.2
        if width > 0:
            lo, hi = quantiles(x, n, [0.01, 0.99])
            at = lo + np.arange(100) * (hi - lo) / 99
            if len(x) <= HELD // 100:
                y = (times * np.exp(-0.5 * ((at[:, None] - x) / width) ** 2)).sum(axis=1)
            else:
                y = np.array([(times * np.exp(-0.5 * ((a - x) / width) ** 2)).sum() for a in at])
            tops = np.flatnonzero((y[1:-1] > y[:-2]) & (y[1:-1] > y[2:]) & (y[1:-1] > 0.25 * y.max())) + 1
            return float(at[tops[0]] if mode == "kde_first_max" and len(tops) else at[y.argmax()])
    return float(quantiles(x, n, [0.5])[0])


def thresholds(mean: tuple[np.ndarray, np.ndarray | None], sd: tuple[np.ndarray, np.ndarray | None], mode, mult) -> Iterator[tuple[str, float, float]]:
    """(mode, that of the means, that of the deviations) of the mode and of those that follow it."""
    a, b = mult if isinstance(mult, (tuple, list)) else (mult, mult)
    if isinstance(mode, (tuple, list)):
        yield "given", mode[0] * a, mode[1] * b
    elif callable(mode):
        yield "function", level(mean[0], mode) * a, level(sd[0], mode) * b
    else:
        if mode not in MODES:
            raise ValueError(f"mode is one of {list(MODES)}, a function or a pair of thresholds, not {mode!r}")
        for m in MODES[MODES.index(mode) :]:
            yield m, level(mean[0], m, mean[1]) * a, level(sd[0], m, sd[1]) * b


def passing(a: np.ndarray, b: np.ndarray, t_mean: float, t_sd: float, maximise: bool) -> np.ndarray:
    """First rows of the windows of one length within the thresholds."""
    return np.flatnonzero((b < t_sd) & ((a > t_mean) if maximise else (a < t_mean)))


def searched(v: np.ndarray, least: int, mode, mult, maximise: bool, **how) -> tuple | None:
    """(mode, threshold of means, that of deviations, length, first row) of a series of up to EXACT windows; length None where no mode has any; None where there is no window."""
    found = [(w, *(x[ok] for x in (np.arange(len(a)), a, b))) for w, a, b in cells(v, range(least, len(v)), least, **how) for ok in [np.isfinite(a) & np.isfinite(b)]]
    if not sum(len(a) for *_, a, _ in found):
        return None
    mean, sd = (np.sort(np.concatenate([f[k] for f in found])) for k in (2, 3))
    for name, t_mean, t_sd in thresholds((mean, None), (sd, None), mode, mult):
        for w, at, a, b in reversed(found):
            ok = passing(a, b, t_mean, t_sd, maximise)
            if len(ok):
                return name, t_mean, t_sd, w, int(at[ok[0]])
    return name, t_mean, t_sd, None, None


def told(idx: np.ndarray, found: tuple | None, least: int) -> tuple:
    """The columns of RESULT."""
    name, t_mean, t_sd, w, first = found or (None, None, None, None, None)
    if w is None:
        return len(idx), None, None, None, None, t_mean, t_sd, name, f"no windows of {least} rows or more" if found is None else "no window is within the thresholds of any mode"
    return len(idx), idx[first], idx[first + w - 1], w, idx[first + before(w)], t_mean, t_sd, name, None


def optimisation(df: DataFrame, values: list[str], ablation: str = "ns", *, least: int = 5, mode: str | Callable | tuple[float, float] = "kde_first_max", mult: float | tuple[float, float] = 1.0, bias: float = 0.0, weights: list[float] | None = None, maximise: bool = False, scaler: str = "median") -> DataFrame:
    """A row for each ablation (over 0) that has a whole row: sample, ablation, and RESULT's columns.

    first, last and centre are idx of rows; they and n_points are null where no
    window passes, which message says. mode is the one that was used: where it
    isn't the asked one, no window passed by that. mean_threshold is in scaled
    units.
    """
    if scaler not in SCALERS:
        raise ValueError(f"scaler is one of {list(SCALERS)}, not {scaler!r}")
    if isinstance(mode, str) and mode not in MODES:
        raise ValueError(f"mode is one of {list(MODES)}, a function or a pair of thresholds, not {mode!r}")
    least = max(2, least)
    key, number, idx = (df.schema[c].dataType.simpleString() for c in ("sample", ablation, "idx"))
    own = {"weights": np.ones(len(values)) if weights is None else np.asarray(weights, float), "bias": bias, "scaler": scaler}
    whole = [F.col(v).cast("double") for v in values]
    rows = df.where((F.col(ablation) > 0) & F.forall(F.array(*whole), lambda x: x.isNotNull() & ~F.isnan(x)))
    ordered = F.array_sort(F.collect_list(F.struct("idx", *[x.alias(f"v{i}") for i, x in enumerate(whole)])))
    series = durable(rows.groupBy("sample", F.col(ablation).alias("ablation")).agg(ordered.alias("rows")))
    n = F.size("rows").cast("long")
    windows = (n - least) * (n - least + 1) - (n - least) * (n - least - 1) / 2
    schema = f"sample {key}, `{ablation}` {number}, " + RESULT.format(idx=idx)
    columns = [x.split(" ")[0].strip("`") for x in schema.split(", ")]

    def arrays(row) -> tuple[np.ndarray, np.ndarray]:
        return np.array([r["idx"] for r in row]), np.array([[r[f"v{i}"] for i in range(len(values))] for r in row], float)

    def short(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for sample, n_, row in zip(pdf["sample"], pdf["ablation"], pdf["rows"], strict=True):
                at, v = arrays(row)
                out.append((sample, n_, *told(at, searched(v, least, mode, mult, maximise, **own) if len(v) > least else None, least)))
            yield pd.DataFrame(out, columns=columns).astype(object)

    few = series.where((n <= least) | (windows <= EXACT)).mapInPandas(short, schema)
    many = series.where((n > least) & (windows > EXACT))
    if many.isEmpty():
        return few
    if callable(mode):
        raise ValueError(f"a function as a mode sees all windows: at most {EXACT} of an ablation")
    # Bounds of lengths, so that each piece has about PIECE windows.
    sizes = F.udf(lambda size: bounds(size, least, PIECE), "array<struct<lo: int, hi: int>>")
    pieces = durable(many.select("sample", "ablation", "rows", F.explode(sizes(n)).alias("w")).repartition(F.col("sample"), F.col("ablation"), F.col("w.lo")))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sample, n_, row, w in zip(pdf["sample"], pdf["ablation"], pdf["rows"], pdf["w"], strict=True):
                _, v = arrays(row)
                both = Counts(), Counts()
                for _, a, b in cells(v, range(w["lo"], w["hi"]), least, **own):
                    ok = np.isfinite(a) & np.isfinite(b)
                    both[0].add(a[ok])
                    both[1].add(b[ok])
                for k, c in enumerate(both):
                    yield c.settle().assign(sample=sample, ablation=n_, kind=k)[["sample", "ablation", "kind", "bin", "n", "total"]]

    def typical(pdf: pd.DataFrame) -> pd.DataFrame:
        """The thresholds of each mode in turn, from counts of one ablation: some hundred thousand at most."""
        x = [(p["total"] / p["n"], p["n"]) for k in (0, 1) for p in [pdf[pdf["kind"] == k]]]
        x = [(v.to_numpy()[o], c.to_numpy()[o]) for v, c in x for o in [np.argsort(v.to_numpy(), kind="stable")]]
        found = list(thresholds(*x, mode, mult)) if len(x[0][0]) else []
        return pd.DataFrame([(pdf["sample"].iloc[0], pdf["ablation"].iloc[0], i, *f) for i, f in enumerate(found)], columns=["sample", "ablation", "turn", "mode", "t_mean", "t_sd"])

    keys = f"sample {key}, ablation {number}"
    counts = pieces.mapInPandas(counted, f"{keys}, kind int, bin long, n long, total double").groupBy("sample", "ablation", "kind", "bin").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    limits = durable(counts.groupBy("sample", "ablation").applyInPandas(typical, f"{keys}, turn int, mode string, t_mean double, t_sd double"))
    turns = limits.groupBy("sample", "ablation").agg(F.array_sort(F.collect_list(F.struct("turn", "mode", "t_mean", "t_sd"))).alias("turns"))  # five at most

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for sample, n_, row, w, turns_ in zip(pdf["sample"], pdf["ablation"], pdf["rows"], pdf["w"], pdf["turns"], strict=True):
                _, v = arrays(row)
                best: dict[int, tuple[int, int]] = {}
                for length, a, b in cells(v, range(w["lo"], w["hi"]), least, **own):
                    for t in turns_:
                        ok = passing(a, b, t["t_mean"], t["t_sd"], maximise)
                        if len(ok):
                            best[t["turn"]] = (length, int(ok[0]))
                yield pd.DataFrame([(sample, n_, t, *x) for t, x in best.items()], columns=["sample", "ablation", "turn", "w", "at"])

    hits = pieces.join(turns, ["sample", "ablation"]).mapInPandas(chosen, f"{keys}, turn int, w int, at int")
    # The first turn that has any, of its windows the longest, of these the leftmost.
    first = hits.groupBy("sample", "ablation").agg(F.min(F.struct("turn", (-F.col("w")).alias("w"), "at")).alias("h"))
    size, at = -F.col("h.w"), F.col("h.at")
    place = lambda i: F.get("rows", i.cast("int"))["idx"]
    last = F.try_element_at("turns", F.lit(-1))
    used = F.coalesce(F.get(F.filter("turns", lambda t: t["turn"] == F.col("h.turn")), 0), last)
    none = F.when(last.isNull(), F.lit(f"no windows of {least} rows or more")).when(F.col("h").isNull(), F.lit("no window is within the thresholds of any mode"))
    joined = many.join(turns, ["sample", "ablation"], "left").join(first, ["sample", "ablation"], "left")
    mid = at + F.when(size % 2 == 1, F.floor(size / 2)).otherwise(F.floor(size / 2) - 1)
    parts = [F.size("rows").alias("n_rows"), place(at).alias("first"), place(at + size - 1).alias("last"), size.cast("int").alias("n_points"), place(mid).alias("centre"), used["t_mean"].alias("mean_threshold"), used["t_sd"].alias("std_threshold"), used["mode"].alias("mode"), none.alias("message")]
    return few.unionByName(joined.select("sample", F.col("ablation").alias(ablation), *parts))


def bounds(n: int, least: int, piece: int) -> list[tuple[int, int]]:
    """Ranges of the lengths from least to n - 1 that have about `piece` windows each."""
    out, lo = [], least
    while lo < n:
        hi = min(n, lo + max(1, piece // (n - lo + 1)))
        out.append((lo, hi))
        lo = hi
    return out


def best_window(values: np.ndarray, least: int = 5, mode: str | Callable | tuple[float, float] = "kde_first_max", mult: float | tuple[float, float] = 1.0, bias: float = 0.0, weights: np.ndarray | None = None, maximise: bool = False, scaler: str = "median") -> tuple[int, int] | None:
    """First and one past the last row, among the whole ones, of one ablation's best window; values has a column for each channel."""
    v = np.asarray(values, float)
    v = v[~np.isnan(v).any(axis=1)]
    found = searched(v, max(2, least), mode, mult, maximise, weights=np.ones(v.shape[1]) if weights is None else np.asarray(weights, float), bias=bias, scaler=scaler) if len(v) > least else None
    return None if found is None or found[3] is None else (found[4], found[4] + found[3])


def optimised(df: DataFrame, values: list[str], ablation: str = "ns", **how) -> DataFrame:
    """df with optimal: whether a row took part, and lies in its ablation's best window."""
    found = optimisation(df, values, ablation, **how).select("sample", ablation, F.col("first").alias("__first"), F.col("last").alias("__last"))
    out = df.join(found, ["sample", ablation], "left")
    took = F.forall(F.array(*[F.col(v).cast("double") for v in values]), lambda x: x.isNotNull() & ~F.isnan(x))
    inside = F.col("idx").between(F.col("__first"), F.col("__last"))
    return out.withColumn("optimal", F.coalesce(inside & took, F.lit(False))).drop("__first", "__last")
