"""Curves through backgrounds against dense systems of all knots."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import background
from tracewright.plans.session import Session


def dense(t, y, kind, at):
    """Truncated powers with a knot at every inner value (cubic, without the outermost two) or middle (quadratic, without the outermost two)."""
    k = 3 if kind == "cubic" else 2
    scale = t[-1] - t[0]
    t0, x, at = t[0], (t - t[0]) / scale, (np.clip(at, t[0], t[-1]) - t[0]) / scale
    breaks = x[2:-2] if k == 3 else ((x[1:] + x[:-1]) / 2)[1:-1]
    basis = lambda p: np.stack([*[p**j for j in range(k + 1)], *[np.maximum(p - b, 0) ** k for b in breaks]], axis=1)
    assert t0 == t[0] and basis(x).shape == (len(t), len(t))
    return basis(at) @ np.linalg.solve(basis(x), y)


def knots_of(spark, groups):
    rows = [(s, float(a), float(b), float(c)) for s, (t, y) in groups.items() for a, b, c in zip(t, y, y * y, strict=True)]
    return spark.createDataFrame(rows, "sample string, knot_time double, v double, w double").repartition(3)


@pytest.mark.parametrize("kind", ["quadratic", "cubic"])
def test_curves_are_dense_solutions(spark, kind):
    rng = np.random.default_rng(3)
    groups = {}
    for s, n in enumerate([4, 5, 9, 14, *([3] if kind == "quadratic" else [])]):
        t = np.cumsum(rng.uniform(0.3, 3, n)) - 2
        groups[f"s{s}"] = (t, rng.normal(5, 2, n))
    knots = background.curved(knots_of(spark, groups), ["v", "w"], kind)
    at = {s: np.concatenate([t, rng.uniform(t[0] - 1, t[-1] + 1, 60), (t[1:] + t[:-1]) / 2]) for s, (t, _) in groups.items()}
    rows = spark.createDataFrame([(s, i, float(x)) for s, xs in at.items() for i, x in enumerate(xs)], "sample string, idx int, u_time double")
    got = {(r["sample"], r.idx): (r.v_at, r.w_at) for r in background.interpolated(rows, knots, ["v", "w"], kind=kind).collect()}
    for s, (t, y) in groups.items():
        for col, values in enumerate((y, y * y)):
            want = dense(t, values, kind, at[s])
            assert np.allclose([got[s, i][col] for i in range(len(at[s]))], want, rtol=1e-6, atol=1e-6)


@pytest.mark.parametrize("kind", ["quadratic", "cubic"])
def test_blocks_of_knots_are_one_curve(spark, kind):
    """Many knots in blocks with borders: what one block would say, at uneven distances."""
    rng = np.random.default_rng(5)
    t = np.cumsum(rng.uniform(0.01, 5, 1000))
    df = knots_of(spark, {"a": (t, rng.normal(0, 1, 1000)), "b": (t[:7], rng.normal(0, 1, 7))})
    one, many = (sorted(map(tuple, background.curved(df, ["v"], kind, size=n).select("sample", "knot_time", "v", "v__b", "v__a").collect())) for n in (10_000, 70))
    assert len(one) == 1007 and np.allclose([r[1:] for r in one], [r[1:] for r in many], rtol=1e-9, atol=1e-9)


def test_steps_between_knots(spark):
    knots = knots_of(spark, {"a": (np.array([0.0, 1.0, 3.0]), np.array([1.0, 2.0, 4.0]))})
    at = [-1.0, 0.0, 0.4, 0.5, 0.6, 1.0, 1.9, 2.0, 2.1, 3.0, 9.0]
    rows = spark.createDataFrame([("a", i, x) for i, x in enumerate(at)], "sample string, idx int, u_time double")
    run = lambda kind: [r.v_at for r in background.interpolated(rows, knots, ["v"], kind=kind).orderBy("idx").collect()]
    assert run("nearest") == [1, 1, 1, 1, 2, 2, 2, 2, 4, 4, 4]
    assert run("previous") == [1, 1, 1, 1, 1, 2, 2, 2, 2, 4, 4]
    assert run("next") == [1, 1, 2, 2, 2, 2, 4, 4, 4, 4, 4]
    with pytest.raises(ValueError):
        background.interpolated(rows, knots, ["v"], kind="round")
    with pytest.raises(ValueError):
        background.curved(knots, ["v"], "cubic")


@pytest.mark.parametrize("kind", ["linear", "nearest", "quadratic", "cubic"])
def test_session_subtracts_by_kind(spark, kind):
    """Five stretches of background on a parabola: curves of two degrees or more follow it."""
    rows, level = [], lambda t: 100 + 0.5 * t - 0.01 * t * t
    for k in range(5):
        for i in range(40):
            t = 50.0 * k + i
            signal = i >= 25
            rows.append((f"s{k}", i, t, t, level(t) + (1000.0 if signal else 0.0), signal, not signal, int(signal)))
    df = spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, sig boolean, bkg boolean, ns int")
    s = Session(df, ["Ca43"])
    s.subtract_background_between(kind=kind)
    means = {}
    for r in rows:
        if r[6]:
            means.setdefault(r[0], []).append((r[3], r[4]))
    t, y = (np.array([np.mean([p[j] for p in means[f"s{k}"]]) for k in range(5)]) for j in (0, 1))
    course = s.background_course(step=10.0).orderBy("u_time").collect()
    at = np.array([r.u_time for r in course])
    if kind in ("quadratic", "cubic"):
        want = dense(t, y, kind, at)
    elif kind == "linear":
        want = np.interp(at, t, y)
    else:
        want = [y[np.argmin(np.round(np.abs(t - x), 9))] for x in np.clip(at, t[0], t[-1])]
    assert at.tolist() == [10.0 * i for i in range(24)] and np.allclose([r.Ca43 for r in course], want)
    if kind in ("quadratic", "cubic"):
        inner = s.df.where("sig AND u_time BETWEEN 20 AND 200").select((F.col("Ca43") - 1000).alias("d")).toPandas()["d"]
        assert np.abs(inner).max() < 1.0
    with pytest.raises(ValueError):
        s.subtract_background_between(kind="step")
