"""Best windows of ablations against windows made one by one."""

import math

import numpy as np
import pytest

from tracewright.operators import optimise
from tracewright.plans.session import Session

MODES = ["kde_first_max", "kde_max", "median", "bayes_mvs", "mean"]


def rescaled(x, by):
    x = np.array(x)
    with np.errstate(all="ignore"):
        if by == "median":
            return (x - np.median(x)) / (np.percentile(x, 75) - np.percentile(x, 25)) if len(x) > 2 else x * np.nan
        if len(x) < 2:
            return x * np.nan
        n, spread = len(x), x.std()
        if by == "bayes" and n <= 1000:  # the mean of the deviation's posterior
            spread = math.sqrt(n * x.var() / 2) * math.gamma((n - 2) / 2) / math.gamma((n - 1) / 2) if 2 < n < 300 else (np.inf if n < 3 else spread * math.sqrt(n / 2) * math.exp(math.lgamma((n - 2) / 2) - math.lgamma((n - 1) / 2)))
        return (x - x.mean()) / (spread if spread > 0 else np.nan)


def typical(x, mode):
    x = np.array(x)
    if mode in ("mean", "bayes_mvs"):
        return x.mean()
    if mode == "median" or not x.std() > 0:
        return np.median(x)
    at = np.linspace(*np.percentile(x, [1, 99]), 100)
    width = x.std(ddof=1) * len(x) ** -0.2
    y = [np.exp(-0.5 * ((a - x) / width) ** 2).sum() for a in at]
    if mode == "kde_first_max":
        for i in range(1, 99):
            if y[i] > y[i - 1] and y[i] > y[i + 1] and y[i] > 0.25 * max(y):
                return at[i]
    return at[int(np.argmax(y))]


def brute(v, least, mode="kde_first_max", mult=1.0, bias=0.0, weights=None, maximise=False, scaler="median"):
    """(mode, length, first row) among the whole rows of v."""
    v = np.array([r for r in v if not np.isnan(r).any()])
    n, k = v.shape if len(v) else (0, 0)
    cells = []
    for w in range(least, n):
        windows = [v[i : i + w] for i in range(n - w + 1)]
        means = [rescaled([x[:, c].mean() for x in windows], scaler) for c in range(k)]
        for i, x in enumerate(windows):
            wts = weights or [1] * k
            m = np.mean([means[c][i] * wts[c] for c in range(k)])
            r = np.mean([x[:, c].std(ddof=1) / abs(x[:, c].mean()) * wts[c] for c in range(k)])
            centre = i + (w // 2 if w % 2 else w // 2 - 1)
            if bias > 0:
                lo = least // 2 if least % 2 else least // 2 - 1
                f = 1 - bias + 2 * bias * (centre - lo) / (n - least)
                m, r = m * f, r * f
            if np.isfinite(m) and np.isfinite(r):
                cells.append((w, i, m, r))
    if not cells:
        return None
    modes = MODES[MODES.index(mode) :] if isinstance(mode, str) else ["given"]
    a, b = mult if isinstance(mult, tuple) else (mult, mult)
    for name in modes:
        t_m, t_r = mode if name == "given" else (typical([c[2] for c in cells], name), typical([c[3] for c in cells], name))
        ok = [(-w, i) for w, i, m, r in cells if r < t_r * b and (m > t_m * a if maximise else m < t_m * a)]
        if ok:
            return name, -min(ok)[0], min(ok)[1]
    return None


def ablations(seed, channels=2, nulls=True):
    """{ns: rows}: some short, some with an inclusion, one constant, one without a whole row."""
    rng = np.random.default_rng(seed)
    out = {}
    for ns in range(1, 9):
        n = int(rng.integers(3, 45))
        x = rng.normal(100, 5, (n, channels)) + np.linspace(0, rng.integers(0, 40), n)[:, None] * (rng.random(channels) > 0.5)
        if nulls:
            x[rng.random((n, channels)) < 0.08] = np.nan
        out[ns] = x
    out[9], out[10] = np.full((20, channels), 7.0), np.full((6, channels), np.nan)
    return out


def frame(spark, of):
    rows = [("a", ns * 1000 + i, ns, *[None if np.isnan(c) and i % 2 else float(c) for c in r]) for ns, x in of.items() for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "sample string, idx int, ns int, " + ", ".join(f"v{i} double" for i in range(len(next(iter(of.values()))[0])))).repartition(3)


HOW = [{}, {"mode": "median"}, {"mode": "kde_max", "scaler": "bayes"}, {"mode": "mean", "maximise": True}, {"bias": 0.3, "weights": [1, 3]}, {"scaler": "standard", "mult": (1.1, 0.8)}, {"mode": (0.2, 0.05)}, {"mult": 0.01}, {"least": 9, "mode": "bayes_mvs", "mult": 0.5}]


@pytest.mark.parametrize("how", HOW)
def test_optimisation_is_brute_force(spark, how):
    how = {"least": 4, **how}
    of = ablations(len(str(how)))
    df = frame(spark, of)
    got = {r.ns: r for r in optimise.optimisation(df, ["v0", "v1"], **how).collect()}
    rows = {ns: sorted(r.idx % 1000 for r in optimise.optimised(df.where(f"ns = {ns}"), ["v0", "v1"], **how).where("optimal").collect()) for ns in (1, 2)}
    assert set(got) == {ns for ns, x in of.items() if (~np.isnan(x).any(axis=1)).any()}
    for ns, r in got.items():
        whole = np.flatnonzero(~np.isnan(of[ns]).any(axis=1)) + ns * 1000
        want = brute(of[ns], **how)
        assert r.n_rows == len(whole)
        if want is None:
            assert r.n_points is None and r["first"] is None and r.message
            continue
        name, w, i = want
        assert (r.mode, r.n_points, r["first"], r["last"], r.message) == (name, w, whole[i], whole[i + w - 1], None)
        assert r.centre == whole[i + (w // 2 if w % 2 else w // 2 - 1)]
        if ns in rows:
            assert rows[ns] == [int(x) % 1000 for x in whole[i : i + w]]


def test_rows_that_are_missing_take_no_part():
    v = np.concatenate([np.random.default_rng(0).normal(10, 0.5, 15), np.random.default_rng(1).normal(30, 0.5, 25)])
    v[4:8] = np.nan
    _, w, i = brute(v[:, None], 5, maximise=True)
    assert optimise.best_window(v[:, None], 5, maximise=True) == (i, i + w)


@pytest.mark.parametrize("how", [{}, {"mode": "median"}, {"mode": "mean", "bias": 0.2, "maximise": True}, {"mult": 1e-9}])
def test_long_series_in_pieces(spark, monkeypatch, how):
    """The way of series with too many windows to keep, on some that have few: thresholds agree to the counts' width."""
    df = frame(spark, ablations(3))
    want = {r.ns: r for r in optimise.optimisation(df, ["v0", "v1"], least=4, **how).collect()}
    monkeypatch.setattr(optimise, "EXACT", 50)
    monkeypatch.setattr(optimise, "PIECE", 40)
    got = {r.ns: r for r in optimise.optimisation(df, ["v0", "v1"], least=4, **how).collect()}
    assert set(got) == set(want) and sum(r.n_rows > 15 for r in got.values()) > 3
    same = 0
    for ns, r in got.items():
        w = want[ns]
        assert (r.n_rows, r.message is None) == (w.n_rows, w.message is None)
        if w.mode == r.mode and w.mean_threshold is not None:
            assert r.mean_threshold == pytest.approx(w.mean_threshold, rel=0.02, abs=0.02) and r.std_threshold == pytest.approx(w.std_threshold, rel=0.02, abs=1e-4)
        same += (r["first"], r["last"]) == (w["first"], w["last"])
    assert same >= len(got) - 2


def test_pieces_cover_all_lengths():
    for n, least, piece in ((100, 5, 300), (1000, 2, 10_000), (6, 5, 1), (50, 5, 10**9)):
        got = optimise.bounds(n, least, piece)
        assert [w for lo, hi in got for w in range(lo, hi)] == list(range(least, n))
        assert sum(optimise.n_windows(n, least, hi) - optimise.n_windows(n, least, lo) for lo, hi in got) == optimise.n_windows(n, least) == sum(n - w + 1 for w in range(least, n))


def test_counts_hold_little():
    c, x = optimise.Counts(), np.random.default_rng(0).normal(0, 1, 3_000_000)
    for part in np.split(x, 30):
        c.add(part)
    found = c.settle()
    assert found["n"].sum() == len(x) and len(found) < 300_000
    v = np.sort((found["total"] / found["n"]).to_numpy())
    o = np.argsort((found["total"] / found["n"]).to_numpy())
    assert np.allclose(optimise.quantiles(v, found["n"].to_numpy()[o], [0.01, 0.5, 0.99]), np.percentile(x, [1, 50, 99]), rtol=1e-3, atol=1e-3)


def test_session_leaves_filtered_rows_out(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(100, 2, 60)
    x[20:24] = 5000.0  # an inclusion, which a filter takes out
    df = spark.createDataFrame([("s", i, float(i), float(i), float(v), 1) for i, v in enumerate(x)], "sample string, idx int, time double, u_time double, Ca43 double, ns int")
    s = Session(df, ["Ca43"])
    s.filter_threshold(channel="Ca43", limit=1000.0)
    s.filter_on(filt="Ca43_thresh_below")
    (name,) = s.filter_optimise_signal(channels=["Ca43"], least=6, mode="median")
    got = [r.idx for r in s.df.where(s.switches.mask(name)).orderBy("idx").collect()]
    kept = np.delete(np.arange(60), np.arange(20, 24))
    _, w, i = brute(x[kept][:, None], 6, mode="median")
    assert got == kept[i : i + w].tolist()
    assert s.optimisation.first().n_points == w


def test_wrong_modes_and_functions(spark):
    df = frame(spark, {1: np.random.default_rng(0).normal(10, 1, (30, 1))})
    for wrong in ({"mode": "most"}, {"scaler": "least"}):
        with pytest.raises(ValueError):
            optimise.optimisation(df, ["v0"], **wrong)
    by = optimise.optimisation(df, ["v0"], mode=lambda x: float(np.median(x))).first()
    plain = optimise.optimisation(df, ["v0"], mode="median").first()
    assert (by["first"], by["last"], by.mode) == (plain["first"], plain["last"], "function")
    empty = optimise.optimisation(df.where("ns > 5"), ["v0"])
    assert empty.collect() == []


def test_means_that_are_equally_apart_stay_so():
    """The windows of three rows have the means 103.89, 97.13 and 90.37, a tie of the density around the middle one: SQL finds no window under any threshold."""
    assert optimise.best_window(np.array([[77.46], [54.17], [180.04], [57.18], [33.89]]), least=3) is None
