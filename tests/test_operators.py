import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewright.functions import chem, names
from tracewright.functions.student import p_of_t
from tracewright.operators import background, calibrate, cluster, despike, frames, masks, optimise, ratio, runs, segment, stats


def trace(spark, values, sample="a", **more):
    rows = [(sample, i, float(i), None if v is None else float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "sample string, idx int, time double, v double")


def column(df, name):
    return [r[name] for r in df.orderBy("sample", "idx").select(name).collect()]


def test_despike_vector(spark):
    got = column(despike.noise(trace(spark, [2000, 2000, 20000, 2000, 2000]), ["v"]), "v")
    assert got[:2] == [2000, 2000] and got[3:] == [2000, 2000]
    assert got[2] == pytest.approx(2666.6666667)


def test_despike_leaves_a_settled_trace(spark):
    once = despike.noise(trace(spark, [5, 900, 5, 5, 700, 5, 5, 6]), ["v"], maxiter=8)
    assert column(despike.noise(once, ["v"], maxiter=1), "v") == column(once, "v")


def test_negative_means_do_not_replace(spark):
    assert column(despike.noise(trace(spark, [-9, -9, -1, -9, -9]), ["v"]), "v") == [-9, -9, -1, -9, -9]


@pytest.mark.parametrize("mask,want", [("FTTFT", [(0, 2), (3, 4)]), ("TTF", [(0, 1)]), ("FFF", []), ("TTT", [(0, 2)])])
def test_run_bounds(spark, mask, want):
    df = trace(spark, [c == "T" for c in mask]).withColumn("m", F.col("v") > 0)
    assert [(r.start, r.stop) for r in runs.bounds(df, "m").orderBy("run").collect()] == want


@pytest.mark.parametrize("start,end", [(1, 1), (2, 0), (0, 2), (1, 0), (3, 2)])
def test_trim_is_circular(spark, start, end):
    m = np.array([1, 1, 0, 1, 1, 1, 0, 0, 1, 1], bool)
    df = trace(spark, m).withColumn("m", F.col("v") > 0)
    assert column(runs.trimmed(df, "m", start, end), "trimmed") == (np.roll(m, start) & np.roll(m, -end)).tolist()


def test_trim_fills_a_single_hole(spark):
    df = trace(spark, [1, 0, 1]).withColumn("m", F.col("v") > 0)
    assert column(runs.trimmed(df, "m", 1, 1), "trimmed")[1] is True


def test_defragment(spark):
    df = trace(spark, [0, 0, 1, 0, 1, 1, 1, 1, 0, 0, 0, 0]).withColumn("m", F.col("v") > 0)
    assert column(runs.defragmented(df, "m", 2, "include"), "defrag") == [False, True] + [True] * 6 + [False] * 4
    assert column(runs.defragmented(df, "m", 2, "exclude"), "defrag") == [False] * 4 + [True] * 4 + [False] * 4


def test_downhole(spark):
    df = trace(spark, [0, 0, 0, 1, 1, 0, 0, 1, 1]).withColumn("m", F.col("v") > 0)
    assert column(runs.without_downhole(df, "m", 2), "kept") == [False, False, False, True, False, False, False, False, False]
    every = trace(spark, [1, 1, 1]).withColumn("m", F.col("v") > 0)
    assert column(runs.without_downhole(every, "m"), "kept") == [True] * 3


def test_enumerate_labels_the_row_before(spark):
    df = trace(spark, [0, 1, 1, 0, 0, 1, 1]).withColumn("m", F.col("v") > 0)
    assert column(runs.enumerated(df, "m"), "ns") == [1, 1, 1, 0, 2, 2, 0]


def test_lagged_smooth_equals_the_array_form(spark):
    v = np.random.default_rng(0).normal(size=40)
    for win in (3, 5, 8):
        got = column(trace(spark, v).withColumn("s", frames.smoothed("v", win)), "s")
        assert np.allclose(got, segment.lagged_mean(v, win))
    got = column(trace(spark, v).withColumn("s", frames.gradient_by_row("v", 5)), "s")
    assert np.allclose(got, segment.slopes(v, 5))


@pytest.mark.parametrize("mode", ["mid", "left", "right"])
def test_gradients(spark, mode):
    v = np.random.default_rng(1).normal(size=20)
    before, after = frames.reach(6, mode)
    full = {i: np.polyfit(np.arange(i - before, i + after + 1), v[i - before : i + after + 1], 1)[0] for i in range(before, 20 - after)}
    want = [full[min(max(i, before), 19 - after)] for i in range(20)]
    assert np.allclose(column(frames.with_gradient(trace(spark, v), "v", 6, mode), "gradient"), want)


def test_thresholds_and_nulls(spark):
    below, above = masks.threshold("v", 2.0)
    got = trace(spark, [1, 2, None, 3]).select("idx", below.alias("b"), above.alias("a")).orderBy("idx").collect()
    assert [(r.b, r.a) for r in got] == [(True, False), (False, True), (False, False), (False, True)]


def test_language(spark):
    df = trace(spark, [1, 2, 3, 4]).withColumn("f__0__x_below", F.col("v") < 3).withColumn("f__0__x_above", F.col("v") >= 3).withColumn("f__1__y", F.col("v") == 2)
    n = ["0:x_below", "0:x_above", "1:y"]
    of = lambda key: column(df.withColumn("k", masks.combined(key, n)), "k")
    assert of("") == [True] * 4
    assert of("x_below & y | x_above") == [False, True, True, True]
    assert of("x_below & (y | x_above)") == [False, True, False, False]
    assert masks.best_match("1:z", n) == "1:y"


def test_switches(spark):
    s = masks.Switches(["p", "q"])
    for name in ("x_below", "x_above"):
        s.add(name, 0)
    assert s.on_ == {"0:x_below": set(), "0:x_above": set()}
    s.turn(True, "x_below", ["p"])
    s.turn(True, 0, ["q"])
    assert s.on_ == {"0:x_below": {"p", "q"}, "0:x_above": {"q"}}
    s.turn(False)
    assert not any(s.on_.values()) and s.status(spark).count() == 4


def test_names(spark):
    df = spark.createDataFrame([("27Al",), ("Al27_Ca43",)], "n string")
    assert [r[0] for r in df.select(names.name_mass(F.col("n"))).collect()] == ["Al27", "Al27_Ca43"]
    assert [r[0] for r in df.select(names.mass_name(F.col("n"))).collect()] == ["27Al", "27Al_43Ca"]
    assert names.in_order(["Sr88", "Mg24", "total", "Ca43"]) == ["Mg24", "Ca43", "Sr88", "total"]
    assert names.resolve("Mg24", ["Mg24_Ca43", "Sr88_Ca43"]) == ["Mg24_Ca43"]
    with pytest.raises(ValueError):
        names.resolve("U238", ["Mg24"])


def test_molecules(spark):
    df = spark.createDataFrame([("CO2",), ("CaCO3",), ("Xx2",)], "f string")
    got = df.select(chem.decomposed(F.col("f")).alias("d"), chem.molar_mass(F.col("f")).alias("m")).collect()
    assert got[0].d == {"C": 1, "O": 2} and got[1].m == pytest.approx(100.086) and got[2].m is None


@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=30))
def test_huber_stays_within_the_values(x):
    mean, sd = stats.huber(np.array(x))
    assert min(x) - 1e-6 <= mean <= max(x) + 1e-6 and sd >= 0


def drawn_in(x):
    """Huber's proposal as it is told: all values are drawn in, round by round."""
    x = np.array(x, float)
    mean, sd = x.mean(), 1.134 * x.std()
    for _ in range(1000):
        lo, hi = mean - 1.5 * sd, mean + 1.5 * sd
        if not ((x < lo) | (x > hi)).any():
            break
        x = np.clip(x, lo, hi)
        mean, sd = x.mean(), 1.134 * x.std()
    return mean, sd


@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=30), st.lists(st.floats(1e5, 1e9), max_size=2))
def test_huber_is_brute_force(x, far):
    assert np.allclose(stats.huber(np.array(x + far)), drawn_in(x + far), rtol=1e-6, atol=1e-6)


def test_kolmogorov_p(spark):
    """Values of Kolmogorov's distribution."""
    df = spark.createDataFrame([(0.5, 0.9639452436), (1.0, 0.2699996717), (1.36, 0.0494858767), (2.0, 0.0006709253), (0.1, 1.0)], "x double, want double")
    got = df.select(stats.kolmogorov_p(F.col("x"), F.lit(2), F.lit(2)).alias("p"), "want").collect()
    assert all(r.p == pytest.approx(r.want, abs=1e-6) for r in got)


def test_slope_p_of_residuals(spark):
    rows = [(float(i), 1.5 * i + (i * 7 % 5)) for i in range(12)]
    got = stats.residual_summary(spark.createDataFrame(rows, "x double, y double"), "x", "y").first()
    x, y = np.array(rows).T
    r = np.corrcoef(x, y - x)[0, 1]
    assert got.slope_p == pytest.approx(float(p_of_t(np.array([r * np.sqrt(10 / (1 - r * r))]), np.array([10]))[0]))


def test_all_elements_have_masses(spark):
    assert len(chem.WEIGHTS) == 92
    df = spark.createDataFrame([("Sm2O3",), ("SnO2",)], "f string")
    assert [round(r[0], 3) for r in df.select(chem.molar_mass(F.col("f"))).collect()] == [348.717, 150.708]


def test_unknown_statistics_are_errors(spark):
    with pytest.raises(ValueError):
        stats.sample_stats(trace(spark, [1]), ["v"], ["nonsense"])
    spread = lambda x: float(np.ptp(x))
    spread.__name__ = "spread"
    assert stats.sample_stats(trace(spark, [1, 5, None]), ["v"], [spread, "mean"]).first().asDict() == {"sample": "a", "v_spread": 4.0, "v_mean": 3.0}


def test_p_values():
    assert np.allclose(p_of_t(np.array([2.0, 0.0, 12.706]), np.array([10, 5, 1])), [0.0733880, 1, 0.05], atol=1e-4)


def test_weighted_background_with_reach_equals_without(spark):
    rng = np.random.default_rng(2)
    rows = [("a", float(t), float(v)) for t, v in zip(np.sort(rng.uniform(0, 100, 200)), rng.normal(50, 3, 200), strict=True)]
    points = spark.createDataFrame(rows, "sample string, u_time double, v double")
    at = background.grid(points, 5.0)
    far, near = (background.weighted(points, at, ["v"], 8.0, reach=r).orderBy("grid_time").collect() for r in (None, 7.0))
    assert len(far) == len(near) and np.allclose([(r.v_mean, r.v_std) for r in far], [(r.v_mean, r.v_std) for r in near], atol=1e-6)


def test_interpolation_equals_numpy(spark):
    df = trace(spark, range(12)).withColumnRenamed("time", "u_time")
    knots = spark.createDataFrame([("a", 2.0, 10.0), ("a", 5.0, 40.0), ("a", 9.0, 0.0)], "sample string, knot_time double, v double")
    assert np.allclose(column(background.interpolated(df, knots, ["v"]), "v_at"), np.interp(np.arange(12), [2, 5, 9], [10, 40, 0]))


def test_calibration_finds_a_planted_line(spark):
    rng = np.random.default_rng(3)
    rows = [("r", float(x), 0.1, 2.5 * x + 1 + float(rng.normal(0, 0.01)), 0.1) for x in range(1, 30)]
    points = spark.createDataFrame(rows, "ratio string, meas_mean double, meas_err double, srm_mean double, srm_err double")
    got = calibrate.calibration(points, ["ratio"], intercept=True).first()
    assert got.m == pytest.approx(2.5, abs=5 * got.m_sd) and got.c == pytest.approx(1, abs=5 * got.c_sd)
    one = calibrate.calibration(points.limit(1), ["ratio"]).first()
    assert one.n == 1 and one.c == 0 and one.m == pytest.approx(rows[0][3] / rows[0][1])


def test_quotient_deviation(spark):
    sd = ratio.quotient_sd(F.lit(6.0), F.lit(0.6), F.lit(3.0), F.lit(0.3))
    assert spark.range(1).select(sd).first()[0] == pytest.approx(2 * np.sqrt(0.02))


def planted(rng):
    t = np.arange(300) * 0.5
    v = np.full(300, 50.0)
    for on, off in ((30, 60), (90, 120)):
        v += 8000 / (1 + np.exp(-(t - on) / 0.6)) - 8000 / (1 + np.exp(-(t - off) / 0.6))
    return t, rng.poisson(v).astype(float)


def test_segments_of_planted_signals(spark):
    t, v = planted(np.random.default_rng(4))
    sig, bkg, trn = segment.segment(t, v)
    assert not (sig & bkg).any() and (sig | bkg | trn).all()
    inside = ((t > 40) & (t < 55)) | ((t > 100) & (t < 115))
    outside = (t < 20) | ((t > 72) & (t < 80)) | (t > 135)
    assert sig[inside].all() and bkg[outside].all()
    df = trace(spark, v).withColumn("time", F.col("idx") * 0.5)
    assert column(segment.segmented(df, "v"), "sig") == sig.tolist()


def test_best_window_avoids_an_inclusion():
    rng = np.random.default_rng(5)
    v = np.concatenate([rng.normal(10, 0.2, 40), rng.normal(40, 8, 15)])
    first, stop = optimise.best_window(v[:, None], least=5)
    assert stop <= 42 and stop - first >= 5


def test_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.2, (40, 2)), rng.normal(5, 0.2, (40, 2))])
    df = spark.createDataFrame([("a", i, *map(float, r)) for i, r in enumerate(x)], "sample string, idx int, p double, q double")
    for found in (cluster.k_means(df, ["p", "q"], 2), cluster.mean_shift(df, ["p", "q"], 1.5), cluster.dbscan(df, ["p", "q"], 1.0)):
        label = [r.k for r in found.orderBy("idx").collect()]
        assert len(set(label[:40])) == len(set(label[40:])) == 1 and label[0] != label[-1]


def test_classifier_orders_its_labels(spark):
    rows = [("a", i, float(i % 2 * 10 + i / 100), None if i == 7 else 1.0) for i in range(40)]
    df = spark.createDataFrame(rows, "sample string, idx int, p double, q double")
    got = {r.idx: r.cluster for r in cluster.Classifier(["p", "q"], 2).fit(df).predict(df).collect()}
    assert got[0] == 0 and got[1] == 1 and got[7] == -2


def test_components(spark):
    rows = [("a", i, float(i), float(2 * i), 0.0) for i in range(20)]
    out, loadings = cluster.principal_components(spark.createDataFrame(rows, "sample string, idx int, p double, q double, z double"), ["p", "q", "z"], 1)
    assert np.allclose(np.abs(loadings[:, 0]), [1 / 5**0.5, 2 / 5**0.5, 0]) and abs(sum(column(out, "pc1"))) < 1e-9


def test_half_cauchy():
    x = np.abs(np.random.default_rng(7).standard_cauchy(20000)) * 3
    assert stats.half_cauchy_scale(x) == pytest.approx(3, rel=0.05)


def test_traces_are_fitted_together(monkeypatch):
    """One call for each length of a window, not for each cut; and each trace as if it were alone."""
    rng, calls, plain = np.random.default_rng(5), [], segment.fit_bells
    traces = [(np.arange(n) * 0.7, rng.exponential(50.0, n)) for n in rng.integers(5, 90, 40)]
    alone = [segment.segment(t, v) for t, v in traces]
    monkeypatch.setattr(segment, "fit_bells", lambda x, *rest: calls.append(len(x)) or plain(x, *rest))
    together = segment.segments(traces)
    assert all((a == b).all() for x, y in zip(alone, together, strict=True) for a, b in zip(x, y, strict=True))
    assert sum(calls) > 200 and len(calls) <= 40


def test_traces_over_batches(spark):
    """Traces longer than what is looked at together, short ones between them, and rows in no order; other columns stay as they are."""
    n = {"a": 3, "b": segment.TOGETHER + 11, "c": 40, "d": 2 * segment.TOGETHER, "e": 30}
    value = F.expr("20 + 5 * sin(idx) + IF(pmod(idx, 400) > 200 OR sample IN ('c', 'e') AND idx > 15, 900, 0)")
    df = spark.createDataFrame(list(n.items()), "sample string, n int").select("sample", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("idx")).select("sample", "idx", (F.col("idx") * 0.5).alias("time"), value.alias("v"), F.array("idx").alias("other"))
    got = segment.segmented(df.orderBy(F.hash("idx")), "v")
    assert got.columns == [*df.select("sample", "idx", "time", "v", "other").columns, "sig", "bkg", "trn"]
    pdf = got.drop("other").toPandas()
    assert got.where("other[0] = idx").count() == sum(n.values())
    for s, rows in pdf.groupby("sample"):
        rows = rows.sort_values("idx")
        want = segment.segment(rows["time"].to_numpy(), rows["v"].to_numpy())
        assert len(rows) == n[s] and all((rows[c].to_numpy() == w).all() for c, w in zip(("sig", "bkg", "trn"), want, strict=True))
