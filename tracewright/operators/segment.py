"""Signal and background of a trace.

A trace is looked at as a whole, with iterations, so this is Python; Spark deals
the traces out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of whole traces that are looked at together, about.
TOGETHER = 1 << 15


def two_means(x: np.ndarray) -> np.ndarray:
    """True for the upper of two clusters, which start at the 5th and the 95th percentile."""
    lo, hi = np.percentile(x, [5, 95])
    for _ in range(300):
        upper = np.abs(x - hi) < np.abs(x - lo)
        if upper.all() or not upper.any():
            break
        new = x[~upper].mean(), x[upper].mean()
        if new == (lo, hi):
            break
        lo, hi = new
    return np.abs(x - hi) < np.abs(x - lo)


def lagged_mean(x: np.ndarray, win: int) -> np.ndarray:
    """frames.smoothed, for one array."""
    h = (win + 1 - win % 2) // 2
    n = len(x)
    sums = np.concatenate([[0.0], np.cumsum(x)])
    i = np.arange(n)
    lo, hi = np.clip(i - h - 1, 0, n), np.clip(i + h, 0, n)
    out = (sums[hi] - sums[lo]) / np.maximum(hi - lo, 1)
    out[: h + 1] = x[: h + 1].mean()
    if h > 1:
        out[-(h - 1) :] = x[-(h - 1) :].mean()
    return out


def slopes(x: np.ndarray, win: int) -> np.ndarray:
    """frames.gradient_by_row, for one array."""
    h = (win + 1 - win % 2) // 2
    out = np.zeros(len(x))
    if len(x) > 2 * h:
        k = np.arange(-h, h + 1)
        out[h : len(x) - h] = np.convolve(x, k[::-1], "valid") / (k * k).sum()
    return out


def fit_bells(x: np.ndarray, y: np.ndarray, start: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    """Height, place and width of a bell curve for each row of x and y, by damped least squares; NaN where one doesn't come to rest.

    Every row takes the steps that it would take alone; all are made together.
    """
    out = np.full((len(x), 3), np.nan)
    live, p, damping = np.arange(len(x)), np.array(start, float), np.full(len(x), 1e-3)

    def curve(p):
        z = (x - p[:, 1:2]) / p[:, 2:]
        e = np.exp(-0.5 * z * z)
        return z, e, (y - p[:, :1] * e) / sigma

    with np.errstate(all="ignore"):
        z, e, r = curve(p)
        for _ in range(60):
            if not len(live):
                break
            slope = p[:, :1] * e * z
            j = np.stack([e / sigma, slope / p[:, 2:] / sigma, slope * z / p[:, 2:] / sigma], axis=2)
            a, b = j.transpose(0, 2, 1) @ j, (j.transpose(0, 2, 1) @ r[:, :, None])[:, :, 0]
            ok = np.isfinite(a).all(axis=(1, 2)) & np.isfinite(b).all(axis=1)
            damped = a + damping[:, None, None] * (np.eye(3) * np.maximum(np.einsum("kii->ki", a), 1e-30)[:, None, :])
            step, solved = solutions(damped, b, ok)
            nz, ne, new = curve(p + step)
            before, after = np.vecdot(r, r), np.vecdot(new, new)
            better = solved & np.isfinite(new).all(axis=1) & (after < before)
            p[better] += step[better]
            for v, w in ((z, nz), (e, ne), (r, new)):
                np.copyto(v, w, where=better[:, None])
            damping = np.where(better, damping / 10, damping * 10)
            done = np.where(better, before - after < 1e-8 * before, damping > 1e12) & solved
            out[live[done]] = p[done]
            on = solved & ~done
            if not on.all():
                live, p, z, e, r, damping, x, y, sigma = (v[on] for v in (live, p, z, e, r, damping, x, y, sigma))
    return out


def solutions(a: np.ndarray, b: np.ndarray, ok: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The solution of each system that is ok, and which have one."""
    step, solved = np.zeros(b.shape), ok.copy()
    try:
        step[ok] = np.linalg.solve(a[ok], b[ok][:, :, None])[:, :, 0]
    except np.linalg.LinAlgError:
        for k in np.flatnonzero(ok):
            try:
                step[k] = np.linalg.solve(a[k], b[k])
            except np.linalg.LinAlgError:
                solved[k] = False
    return step, solved


def segment(time: np.ndarray, signal: np.ndarray, *, parts: dict | None = None, **how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """segments() of one trace."""
    return segments([(time, signal)], parts=None if parts is None else [parts], **how)[0]


def segments(traces: list[tuple[np.ndarray, np.ndarray]], gwin: int = 5, swin: int = 3, win: int = 20, on_mult=(1.0, 1.5), off_mult=(1.5, 1.0), threshold: float | None = None, parts: list[dict] | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Masks of signal, background and transition of each trace (time, signal); parts takes the series that they are told from.

    The logarithm of the lagged mean is cut in two; around every cut a bell
    curve on the gradient gives the transition's width, and rows within the
    given multiples of it are neither signal nor background. Where no curve
    fits, the mean of those that did is taken. Curves of all traces are fitted
    together.
    """
    out, cuts = [], {}
    for k, (time, signal) in enumerate(traces):
        v = np.asarray(signal, float).copy()
        n = len(v)
        positive = v[v > 0]
        if n < 2 * swin + 2 or not len(positive):
            none = np.zeros(n, bool)
            out.append((none, ~none))
            continue
        v[v <= 0] = positive.min()
        smooth = np.log(lagged_mean(v, swin))
        upper = smooth > np.log(threshold) if threshold else two_means(smooth)
        upper[0] = False
        out.append((upper.copy(), ~upper))
        gradient = np.abs(slopes(v, gwin))
        if parts is not None:
            parts[k] |= {"smooth": smooth, "gradient": gradient, "upper": upper}
        for z in np.flatnonzero(upper[1:] != upper[:-1]).tolist():
            lo, hi = max(0, z - win), min(n, z + win)
            rising = bool(smooth[min(n - 1, z + 3)] > smooth[max(0, z - 3)])
            cuts[k, z] = (lo, hi, rising, gradient[lo:hi])
    fitted, sizes = {}, {}
    for key, (lo, hi, *_) in cuts.items():
        sizes.setdefault(hi - lo, []).append(key)
    for keys in sizes.values():
        x = np.array([traces[k][0][cuts[k, z][0] : cuts[k, z][1]] for k, z in keys])
        y = np.array([cuts[key][3] for key in keys])
        at = np.array([traces[k][0][z] for k, z in keys])
        step = np.array([traces[k][0][1] - traces[k][0][0] for k, _ in keys])
        fitted |= zip(keys, fit_bells(x, y, np.stack([y.max(axis=1), at, 2 * step], axis=1), (x - at[:, None]) ** 2 + 0.01), strict=True)
    widths: dict[int, list[tuple[float, float, bool]]] = {}
    failed: list[tuple[int, float, bool]] = []
    for (k, z), (lo, hi, rising, _) in cuts.items():
        time, (sig, bkg) = traces[k][0], out[k]
        _, place, sigma = fitted[k, z]
        width = abs(2 * sigma * np.sqrt(2 * np.log(2)))
        if not np.isnan(place) and lo <= np.searchsorted(time, place) <= hi and width < time[-1] - time[0]:
            before, after = on_mult if rising else off_mult
            gone = (time > place - width * before) & (time < place + width * after)
            sig[gone] = bkg[gone] = False
            widths.setdefault(k, []).append((width * before, width * after, rising))
        else:
            failed.append((k, time[z], rising))
    for k, at, rising in failed:
        time, (sig, bkg), found = traces[k][0], out[k], widths.get(k, [])
        own = [w for w in found if w[2] == rising] or found
        half = np.mean([(a + b) / 2 for a, b, _ in own]) if own else 2 * (time[1] - time[0])
        gone = (time > at - half) & (time < at + half)
        sig[gone] = bkg[gone] = False
    return [(sig, bkg, ~(sig | bkg)) for sig, bkg in out]


def segmented(df: DataFrame, value: str, time: str = "time", **how) -> DataFrame:
    """df with sig, bkg and trn. Rows stream through a task in order of sample; traces are looked at together, TOGETHER rows or one trace at a time."""
    narrow = df.where("sample IS NOT NULL AND idx IS NOT NULL")
    columns = ["sample", "idx", *[c for c in df.columns if c not in ("sample", "idx")]]
    rows = narrow.select(F.col(time).cast("double").alias("__t"), F.col(value).cast("double").alias("__v"), *columns)
    kinds = T.StructType([*[rows.schema[c] for c in columns], *[T.StructField(c, T.BooleanType()) for c in ("sig", "bkg", "trn")]])

    def masks(whole: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        t, v = (whole[c].to_numpy() for c in ("__t", "__v"))
        v = np.nan_to_num(v.astype(float), nan=0.0, posinf=np.inf, neginf=-np.inf)
        found = segments([(t[a:b], v[a:b]) for a, b in zip(np.r_[0, ends[:-1]], ends, strict=True)], **how)
        out = whole.select(columns)
        for c, x in zip(("sig", "bkg", "trn"), zip(*found, strict=True), strict=True):
            out = out.append_column(c, pa.array(np.concatenate(x)))
        yield from out.to_batches(max_chunksize=TOGETHER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, last = [], 0, None
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            n += b.num_rows
            if n < TOGETHER or b["sample"][0] == b["sample"][-1] == last:
                last = b["sample"][-1]
                continue
            whole = pa.Table.from_batches(held)
            starts = changes(whole["sample"])
            if len(starts):
                yield from masks(whole.slice(0, starts[-1]), starts)
                whole = whole.slice(starts[-1])
            held, n, last = whole.to_batches(), whole.num_rows, b["sample"][-1]
        if held:
            whole = pa.Table.from_batches(held)
            yield from masks(whole, np.r_[changes(whole["sample"]), whole.num_rows])

    return rows.repartition("sample").sortWithinPartitions("sample", "idx").mapInArrow(run, kinds)


def changes(keys: pa.ChunkedArray) -> np.ndarray:
    """Places, over 0, whose key isn't that of the place before."""
    whole = keys.combine_chunks()
    return np.flatnonzero(pc.not_equal(whole[1:], whole[:-1]).to_numpy(zero_copy_only=False)) + 1


def components(df: DataFrame, value: str, time: str = "time", **how) -> DataFrame:
    """(sample, idx, smooth, gradient, upper, sig, bkg, trn): the masks with what they are told from, the logarithm of the lagged mean, the size of its slope and the upper cluster; null where a trace is too short or has no signal."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, parts = pdf.sort_values("idx", kind="stable"), {}
        sig, bkg, trn = segment(pdf["t"].to_numpy(float), pdf["v"].fillna(0).to_numpy(float), parts=parts, **how)
        found = {c: parts.get(c, [None] * len(pdf)) for c in ("smooth", "gradient", "upper")}
        return pd.DataFrame({"sample": pdf["sample"], "idx": pdf["idx"], **found, "sig": sig, "bkg": bkg, "trn": trn})

    key, idx = (df.schema[c].dataType.simpleString() for c in ("sample", "idx"))
    narrow = df.selectExpr("sample", "idx", f"`{time}` AS t", f"`{value}` AS v")
    return narrow.groupBy("sample").applyInPandas(run, f"sample {key}, idx {idx}, smooth double, gradient double, upper boolean, sig boolean, bkg boolean, trn boolean")
