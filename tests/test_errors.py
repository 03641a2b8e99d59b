"""Errors with shared sources against dense covariances, propagated step by step."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.functions.errors import Uncertain, pair
from tracewright.operators import calibrate
from tracewright.plans.session import Session

N = 5


class Dense:
    """All values so far and their whole covariance matrix; each step is one row of a Jacobian."""

    def __init__(self, x, cov):
        self.x, self.cov = list(x), np.array(cov, float)

    def step(self, value, slopes):
        j = np.zeros(len(self.x))
        for i, s in slopes:
            j[i] += s
        across = self.cov @ j
        self.cov = np.block([[self.cov, across[:, None]], [across[None, :], np.array([[j @ across]])]])
        self.x.append(value)


@pytest.mark.parametrize("seed", range(6))
def test_random_chains_are_dense_products(spark, seed):
    rng = np.random.default_rng(seed)
    x, sd = rng.uniform(1, 5, N), rng.uniform(0.01, 0.3, N)
    dense, own = Dense(x, np.diag(sd**2)), [Uncertain(F.lit(float(v)), {f"s{i}": F.lit(float(s))}) for i, (v, s) in enumerate(zip(x, sd, strict=True))]
    for _ in range(12):
        a, b = (int(i) for i in rng.integers(0, len(own), 2))
        p, q = dense.x[a], dense.x[b]
        op = rng.choice(["+", "-", "*", "/", "k"])
        if op == "/" and abs(q) < 0.2 or op == "*" and abs(p * q) > 1e3:
            op = "k"
        if op == "+":
            own.append(own[a] + own[b])
            dense.step(p + q, [(a, 1), (b, 1)])
        elif op == "-":
            own.append(own[a] - own[b])
            dense.step(p - q, [(a, 1), (b, -1)])
        elif op == "*":
            own.append(own[a] * own[b])
            dense.step(p * q, [(a, q), (b, p)])
        elif op == "/":
            own.append(own[a] / own[b])
            dense.step(p / q, [(a, 1 / q), (b, -p / q**2)])
        else:
            own.append(own[a] * 0.5 + 2.0)
            dense.step(0.5 * p + 2, [(a, 0.5)])
    row = spark.range(1).select(*[c.alias(f"{n}{i}") for i, u in enumerate(own) for n, c in (("v", u.value), ("e", u.sd()))]).first()
    assert np.allclose([row[f"v{i}"] for i in range(len(own))], dense.x)
    assert np.allclose([row[f"e{i}"] for i in range(len(own))], np.sqrt(np.maximum(np.diag(dense.cov), 0)), atol=1e-7)


def test_pairs_and_nulls(spark):
    a, b = pair(F.lit(2.0), F.lit(0.3), F.lit(5.0), F.lit(0.4), F.lit(-0.09), ("a", "b"))
    same = a - a
    nothing = a / (a - a)
    row = spark.range(1).select(*[u.sd().alias(n) for n, u in (("a", a), ("b", b), ("sum", a * 3.0 + b), ("same", same), ("none", nothing))]).first()
    assert (row.a, row.same, row.none) == (0.3, 0.0, None)
    assert row.b == pytest.approx(0.4) and row["sum"] == pytest.approx(np.sqrt(9 * 0.09 + 0.16 - 6 * 0.09))


def bare(spark):
    """A sample on a known background, three channels."""
    rng, rows = np.random.default_rng(1), []
    for k in range(3):
        for i in range(60):
            signal = 20 <= i < 50
            base = [10 + rng.normal(0, 2), 20 + rng.normal(0, 4), 5 + rng.normal(0, 1)]
            add = [1000.0, 400.0, 80.0] if signal else [0.0] * 3
            t = 60.0 * k + i
            rows.append((f"s{k}", i, float(i), t, *[float(b + a) for b, a in zip(base, add, strict=True)], signal, i < 18 or i > 52, int(signal)))
    return spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, Mg24 double, Sr88 double, sig boolean, bkg boolean, ns int")


def test_a_standard_s_error_cancels_where_it_must(spark):
    s = Session(bare(spark), ["Ca43", "Mg24", "Sr88"])
    s.subtract_background_between(n_min=5)
    b = s.stage("bkgsub").where("sample = 's1' AND idx = 30").first()
    s.correct_interference(target="Mg24", source="Ca43", factor=0.1)
    s.ratio(standard="Ca43")
    s.combine(name="Mg24_Sr88", top="Mg24_Ca43", below="Sr88_Ca43")
    r = s.df.where("sample = 's1' AND idx = 30").first()
    ca, mg, sr = b.Ca43, b.Mg24, b.Sr88
    sds = np.array([b.Ca43_sd, b.Mg24_sd, b.Sr88_sd])
    t = mg - 0.1 * ca
    assert r.Mg24 == pytest.approx(t) and r.Mg24_sd == pytest.approx(np.hypot(sds[1], 0.1 * sds[0]))
    # t / ca is mg / ca - 0.1: the standard's error comes in once.
    assert r.Mg24_Ca43_sd == pytest.approx(np.hypot(sds[1] / ca, mg / ca**2 * sds[0]))
    # Of (t / ca) / (sr / ca) only the interference is left of it.
    assert r.Mg24_Sr88 == pytest.approx(t / sr) and r.Mg24_Sr88_sd == pytest.approx(np.linalg.norm([0.1 / sr, 1 / sr, t / sr**2] * sds))
    assert not [c for c in s.stage().columns if c.startswith("__err")]
    assert "combine" in [x["step"] for x in s.log]


def test_line_covariance(spark):
    rng = np.random.default_rng(2)
    x = rng.uniform(1, 9, 7)
    y = 2 * x + 1 + rng.normal(0, 0.3, 7)
    e = rng.uniform(0.1, 0.4, 7)
    df = spark.createDataFrame([("r", float(a), float(b), float(c), 0.05) for a, b, c in zip(x, y, e, strict=True)], "ratio string, meas_mean double, srm_mean double, meas_err double, srm_err double")
    got = calibrate.calibration(df, ["ratio"], True).first()
    w = 1 / (e**2 + 0.05**2)
    A = np.stack([x, np.ones(7)], axis=1)
    inverse = np.linalg.inv(A.T @ (w[:, None] * A))
    p = inverse @ (A.T @ (w * y))
    cov = inverse * (w * (y - A @ p) ** 2).sum() / 5
    assert np.allclose([got.m, got.c, got.m_sd, got.c_sd, got.mc_cov], [*p, *np.sqrt(np.diag(cov)), cov[0, 1]])
