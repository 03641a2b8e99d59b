"""Robust statistics of large groups by cells against the array of each."""

import numpy as np
import pytest

from tracewright.operators import robust, stats


def groups(rng):
    n = 4000
    return {
        "normal": rng.normal(5, 2, n),
        "heavy": rng.standard_cauchy(n),
        "far": np.concatenate([rng.normal(0, 1, n), [1e9, -1e12]]),
        "equal": np.full(50, 3.5),
        "two": np.repeat([1.0, 2.0], [3000, 30]),
        "steps": rng.integers(0, 6, n).astype(float),
        "shifted": rng.normal(1e7, 1e-2, n),
        "one": np.array([7.0]),
        "skew": rng.exponential(3, n) ** 3,
    }


@pytest.mark.parametrize("cells", [16, 4096])
def test_cells_are_arrays(spark, monkeypatch, cells):
    monkeypatch.setattr(robust, "CELLS", cells)
    of = groups(np.random.default_rng(4))
    rows = [(k, float(x)) for k, v in of.items() for x in v] + [("normal", None), ("none", None), (None, 4.0), ("skew", float("nan"))]
    df = spark.createDataFrame(rows, "sample string, v double").repartition(6)
    got = {r["sample"]: r for r in robust.huber_of_groups(df, ["sample"], "v").collect()}
    assert set(got) == {*of, None} and got[None].mean == 4.0
    for k, v in of.items():
        mean, sd = stats.huber(v)
        assert got[k].n == len(v)
        assert got[k].mean == pytest.approx(mean, rel=1e-9, abs=1e-9) and got[k].sd == pytest.approx(sd, rel=1e-6, abs=1e-9)


def test_sample_stats_of_large_groups(spark, monkeypatch):
    """A group over the bound has what it has under it."""
    rng = np.random.default_rng(2)
    rows = [("large", 1, float(x), float(y)) for x, y in rng.normal(10, 3, (3000, 2)) ** 2] + [("small", 1, float(x), None) for x in rng.normal(0, 1, 40)] + [("large", 2, 1.0, 2.0)]
    df = spark.createDataFrame(rows, "sample string, ns int, v double, w double").repartition(4)

    def spread(x):
        return x.max() - x.min() if len(x) else np.nan

    how = dict(stats=["mean", "H15_mean", "H15_std", "H15_se", "n", spread], masks={"v": df["v"] < 200}, by=("sample", "ns"))
    table = lambda x: {(r["sample"], r.ns): [r[c] for c in x.columns[2:]] for r in x.collect()}
    want = stats.sample_stats(df, ["v", "w"], **how)
    monkeypatch.setattr(stats, "WHOLE", 1000)
    got = stats.sample_stats(df, ["v", "w"], **how)
    assert got.columns == want.columns
    a, b = table(got), table(want)
    assert set(a) == set(b) and len(a) == 3
    for k in a:
        assert all(x == y or (x is None or np.isnan(x)) and (y is None or np.isnan(y)) or x == pytest.approx(y, rel=1e-9) for x, y in zip(a[k], b[k], strict=True))
