import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import stats, washout
from tracewright.plans.session import Session, read_log, reproduced
from tracewright.sources import tables
from tracewright.streaming import sessions

TRUTH = {"STD1": 0.02, "STD2": 0.08, "smp1": 0.05, "smp2": 0.03}


def build(spark):
    rng = np.random.default_rng(8)
    rows, offset = [], 0.0
    for name, ratio in TRUTH.items():
        t = np.arange(160) * 0.5
        shape = 1 / (1 + np.exp(-(t - 20) / 0.6)) - 1 / (1 + np.exp(-(t - 60) / 0.6))
        ca, mg = rng.poisson(40 + 40000 * shape), rng.poisson(20 + 40000 * 1.7 * ratio * shape)
        rows += [(name, i, float(t[i]), float(t[i] + offset), float(ca[i]), float(mg[i])) for i in range(160)]
        offset += 80
    df = spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, Mg24 double")
    refs = spark.createDataFrame([("A", "Mg24_Ca43", 0.02, 0.0001), ("B", "Mg24_Ca43", 0.08, 0.0001)], "srm string, ratio string, srm_mean double, srm_err double")
    return Session(df, ["Ca43", "Mg24"], references=refs)


def reduce(s):
    s.despike().autorange().subtract_background(fwhm=60.0).ratio(standard="Ca43").calibrate()
    s.filter_threshold(channel="Ca43", limit=1000.0)
    s.filter_on(filt="Ca43_thresh_above")
    return s.sample_stats(stats_=["mean", "n"])


def test_reduction_recovers_the_truth_and_replays(spark, tmp_path):
    s = reduce(build(spark))
    got = {r.sample: r["Mg24_Ca43_mean"] for r in s.stats.collect()}
    for name, want in TRUTH.items():
        assert got[name] == pytest.approx(want, rel=0.05), got
    s.save_log(str(tmp_path / "log"))
    log = read_log(spark, str(tmp_path / "log"))
    assert [x["step"] for x in log][:3] == ["despike", "autorange", "subtract_background"]
    again = build(spark).replay(log)
    assert {r.sample: round(r["Mg24_Ca43_mean"], 9) for r in again.stats.collect()} == {k: round(v, 9) for k, v in got.items()}
    with pytest.raises(ValueError):
        again.replay([{"step": "__init__", "args": {}}])


def test_subsets(spark):
    s = build(spark)
    assert s.make_subset(samples=["smp1"], name="one") == "one"
    assert s.make_subset(samples=["smp1"], name="two") == "one"
    assert s.make_subset(samples=["smp1"], name="two", force=True) == "two"
    names = lambda x: {r.sample for r in s.of(x).select("sample").distinct().collect()}
    assert names("All_Samples") == {"smp1", "smp2"} and names("STD") == {"STD1", "STD2"} and names("not_in_set") == set(TRUTH) - {"smp1"} and names("one") == {"smp1"}


def test_stream_sessions_equal_the_batch(spark, tmp_path):
    rows = [("a", f"2024-01-01 00:{m:02d}:00", v) for m, v in ((0, 50.0), (5, 60.0), (6, 1.0), (40, 70.0), (59, 80.0))]
    df = spark.createDataFrame(rows, "sample string, t string, value double").select("sample", F.to_timestamp("t").alias("ts"), "value")
    df.write.parquet(str(tmp_path / "in"))
    batch = {tuple(r) for r in sessions.signal_sessions(df, 10.0, "20 minutes").collect()}
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = sessions.signal_sessions(stream, 10.0, "20 minutes").writeStream.outputMode("complete").format("memory").queryName("sessions").option("checkpointLocation", str(tmp_path / "state")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("sessions").collect()} == batch and len(batch) == 2


def drifting(spark, factor=lambda t: 1.0, samples=("STD1", "STD2", "smp1", "smp2", "STD3", "STD4", "smp3", "smp4", "STD5", "STD6")):
    """Standards and samples in turn, whose measured ratio is the true one times factor of the time."""
    rng = np.random.default_rng(9)
    truth = {s: (0.02, 0.08)[int(s[3:]) % 2] if s.startswith("STD") else 0.05 for s in samples}
    rows, offset = [], 0.0
    for k, s in enumerate(samples):
        t = np.arange(120) * 0.5
        on = (t > 15) & (t < 45)
        for i in range(120):
            ca = 40_000.0 if on[i] else 20.0
            mg = float(ca * truth[s] * factor(t[i] + offset)) if on[i] else 5.0
            rows.append((s, i, float(t[i]), float(t[i] + offset), ca + float(rng.normal(0, 2)), mg + float(rng.normal(0, 1)), bool(on[i]), not bool(on[i]), int(on[i])))
        offset += 60
    df = spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, Mg24 double, sig boolean, bkg boolean, ns int")
    refs = spark.createDataFrame([("A", "Mg24_Ca43", 0.02, 0.0001), ("B", "Mg24_Ca43", 0.08, 0.0001)], "srm string, ratio string, srm_mean double, srm_err double")
    conc = spark.createDataFrame([(s, 0.4) for s in samples if s != "smp4"], "sample string, int_stand_massfrac double")
    return Session(df, ["Ca43", "Mg24"], references=refs, concentrations=conc), truth


def test_drift_is_followed(spark):
    """The sensitivity grows by a fifth in the run: lines of each group of standards follow it, one line doesn't."""
    factor = lambda t: 1 + 0.2 * t / 600
    found = {}
    for drift in (True, False):
        s, truth = drifting(spark, factor)
        s.subtract_background_between(n_min=10).ratio(standard="Ca43").calibrate(drift=drift)
        found[drift] = {r.sample: r.m for r in s.df.where("ns > 0").groupBy("sample").agg(F.avg("Mg24_Ca43").alias("m")).collect()}
        if drift:
            assert s.lines.count() == 3 and s.df.count() == 1200
    error = {d: max(abs(found[d][s] / truth[s] - 1) for s in ("smp1", "smp2", "smp3", "smp4")) for d in found}
    assert error[True] < 0.01 < error[False]


def test_drift_interpolates_between_group_means(spark):
    s, _ = drifting(spark, lambda t: 1 + 0.2 * t / 600)
    s.subtract_background_between(n_min=10).ratio(standard="Ca43")
    before = {(r.sample, r.idx): r for r in s.df.where("sig").collect()}
    s.calibrate(drift=True)
    knots = sorted((r.knot_time, r.m, r.m_sd) for r in s.lines.collect())
    at, m, sd = (np.array(x) for x in zip(*knots, strict=True))
    for r in s.df.where("sig").collect():
        b = before[r.sample, r.idx]
        line, line_sd = np.interp(r.u_time, at, m), np.interp(r.u_time, at, sd)
        assert r.Mg24_Ca43 == pytest.approx(b.Mg24_Ca43 * line)
        assert r.Mg24_Ca43_sd == pytest.approx(np.hypot(line * b.Mg24_Ca43_sd, b.Mg24_Ca43 * line_sd))


def test_uncertainties_go_on(spark):
    s, _ = drifting(spark)
    s.subtract_background(fwhm=30.0).ratio(standard="Ca43").calibrate().mass_fraction(masses={"Mg24_Ca43": [24.305, 40.078]})
    r = s.df.where("sample = 'smp1' AND sig").first()
    ca, mg = r.Ca43, r.Mg24
    plain = mg / ca
    assert r.Ca43_sd > 0 and r.Mg24_sd > 0
    line = s.lines.first()
    plain_sd = plain * np.hypot(r.Mg24_sd / mg, r.Ca43_sd / ca)
    assert r.Mg24_Ca43 == pytest.approx(plain * line.m) and r.Mg24_Ca43_sd == pytest.approx(np.hypot(line.m * plain_sd, plain * line.m_sd))
    assert r.Mg24_massfrac == pytest.approx(r.Mg24_Ca43 * 0.4 * 24.305 / 40.078) and r.Mg24_massfrac_sd == pytest.approx(r.Mg24_Ca43_sd * 0.4 * 24.305 / 40.078)
    none = s.df.where("sample = 'smp4' AND sig").first()
    assert none.Mg24_massfrac is None and none.Mg24_massfrac_sd is None


@pytest.mark.parametrize("drift", [False, True])
def test_calibration_without_standards_keeps_rows(spark, drift):
    s, _ = drifting(spark)
    s.subtract_background_between(n_min=10).ratio(standard="Ca43").calibrate(n_min=10_000, drift=drift)
    assert s.df.count() == 1200 and s.df.where("Mg24_Ca43 IS NOT NULL").count() == 0


def test_background_outliers_leave(spark):
    rows = [("a", i, float(i), float(i), 500.0 if 60 <= i < 70 else 10.0 + i % 3, i % 10 < 8) for i in range(100)]
    df = spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, bkg boolean")
    s = Session(df, ["Ca43"]).filter_background(win=2, n_lim=3.0, n_min=3)
    out = {r.idx for r in s.df.where("NOT bkg").collect()} - {i for i in range(100) if i % 10 >= 8}
    assert out == set(range(60, 68)) and s.df.count() == 100


def washing(spark):
    """Standards that fall by exp(-1.3 t) after they end, on a steep edge."""
    rows = []
    for s in ("STD1", "STD2"):
        t = np.arange(100) * 0.25
        v = np.where(t < 5, 1.0, np.where(t < 15, 10_000.0, 1.0 + 9_999.0 * np.exp(-1.3 * (t - 15))))
        trn = ((t > 4.5) & (t < 6)) | ((t > 14.5) & (t < 21))
        rows += [(s, i, float(t[i]), float(v[i]), bool(trn[i])) for i in range(100)]
    return spark.createDataFrame(rows, "sample string, idx int, time double, total_counts double, trn boolean")


def brute_exponent(df):
    """The washouts by plain loops, the fit by a search."""
    points = {}
    for s in ("STD1", "STD2"):
        rows = [r for r in df.orderBy("idx").collect() if r.sample == s]
        t, v, trn = (np.array([r[c] for r in rows]) for c in ("time", "total_counts", "trn"))
        runs, start = [], None
        for i in range(len(t)):
            if trn[i] and start is None:
                start = t[max(0, i - 1)]
            if start is not None and (i + 1 == len(t) or not trn[i + 1]):
                runs.append((start, t[i]))
                start = None
        for lo, hi in runs[-1::-2]:
            y = v[(t > lo) & (t < hi)]
            y = (y - y.min()) / (y.max() - y.min())
            m = np.array([sum(y[max(0, i - 1) : i + 2]) / 3 for i in range(len(y))])
            m[0] = m[1]
            fall = m - np.append(m[1:], 0)
            steep = fall >= 0.5 * fall.max()
            first = next(i for i in range(len(y)) if steep[i] != steep[(i + 1) % len(y)])
            tail = y[first + 2 :]
            tail = (tail - tail.min()) / (tail.max() - tail.min())
            for k, x in enumerate(tail):
                at = round(k * (t[2] - t[1]), 2)
                points[at] = min(points.get(at, 2.0), x)
    at, y = (np.array(x) for x in zip(*sorted(points.items()), strict=True))
    grid = np.linspace(-5, -0.01, 200_001)
    return grid[np.argmin([((y - np.exp(e * at)) ** 2).sum() for e in grid[::20]]) * 20], at, y


def test_washout_exponent(spark):
    df = washing(spark)
    tails = washout.tails(df)
    want, at, y = brute_exponent(df)
    got = washout.exponent(tails, below=2.0)
    least = sorted((r.t, r.y) for r in tails.groupBy("t").agg(F.min("y").alias("y")).collect())
    assert np.allclose([t for t, _ in least], at) and np.allclose([v for _, v in least], y)
    assert got["exponent"] == pytest.approx(want, abs=1e-3) and got["exponent"] == pytest.approx(-1.3, rel=0.1)
    assert got["used"] == pytest.approx(got["exponent"] - 2 * got["sd"]) and 0.9 < got["r2"] <= 1
    s = Session(df, ["total_counts"])
    assert s.find_expcoef() == pytest.approx(got["exponent"]) == pytest.approx(s.exponent)
    with pytest.raises(ValueError):
        washout.exponent(washout.tails(df.withColumn("trn", F.lit(False))))


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 1.8), (3.0, 3.3)], "y double, m double")
    y, m = np.array([1.0, 2, 3]), np.array([1.1, 1.8, 3.3])
    rest = ((y - m) ** 2).sum()
    assert stats.r2(df, "y", F.col("m")) == pytest.approx(1 - rest / ((y - 2) ** 2).sum()) and stats.r2(df, "y", F.col("m"), True) == pytest.approx(1 - rest / (y**2).sum())


def steps(s):
    s.despike().autorange(channel="Ca43").filter_background(win=2).subtract_background_between(n_min=5)
    s.ratio(standard="Ca43").calibrate(drift=True)
    s.filter_gradient_percentile(channel="Mg24", percentiles=[90.0], win=5)
    s.filter_clustering(channels=["Mg24"], method="kmeans", clusters=2)
    s.filter_clustering(channels=["Mg24"], level="population", clusters=2)
    s.fit_classifier(name="levels", channels=["Ca43"], clusters=2)
    s.apply_classifier(name="levels")
    s.filter_optimise_signal(channels=["Mg24"], least=10)
    s.filter_on(filt="optimise_Mg24")
    return s.sample_stats(stats_=["mean", "H15_mean", "n"])


def test_every_step_replays_from_a_minimal_export(spark, tmp_path):
    s = steps(build(spark))
    s.minimal_export(str(tmp_path / "min"))
    again = reproduced(spark, str(tmp_path / "min"))
    key = lambda x: sorted(tuple(f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in x.stats.collect())
    assert key(again) == key(s) and [x["step"] for x in again.log] == [x["step"] for x in s.log]
    assert again.switches.on_ == s.switches.on_
    effect = {r.sample: r for r in s.filter_effect(channels=["Mg24"]).collect()}
    assert set(effect) == set(TRUTH)
    assert s.gradients(channels=["Mg24"], win=5).count() == 640


def test_stages_can_be_read_and_exported(spark, tmp_path):
    s = build(spark)
    raw = {(r.sample, r.idx): r.Ca43 for r in s.df.collect()}
    s.despike().autorange(channel="Ca43").subtract_background(fwhm=60.0).ratio(standard="Ca43")
    s.filter_threshold(channel="Ca43", limit=1000.0)
    s.filter_on(filt="Ca43_thresh_above", channels=["Ca43"])
    assert {(r.sample, r.idx): r.Ca43 for r in s.stage("rawdata").collect()} == raw
    assert "Mg24_Ca43" not in s.stage("bkgsub").columns and "Mg24_Ca43" in s.stage("ratios").columns
    with pytest.raises(ValueError):
        s.stage("nonsense")
    s.export_traces(str(tmp_path / "t"), stage="rawdata", subset=["smp1"], filt=True)
    got = {r.idx: r for r in tables.read_traces(spark, str(tmp_path / "t")).collect()}
    assert {r.sample for r in got.values()} == {"smp1"} and len(got) == 160
    kept = {r.idx for r in s.of(["smp1"]).where(F.col("`f__0__Ca43_thresh_above`")).collect()}
    assert kept and all((got[i].Ca43 == raw["smp1", i]) if i in kept else got[i].Ca43 is None for i in got) and all(r.Mg24 is not None for r in got.values())
    s.export_traces(str(tmp_path / "r"), channels=["Mg24_Ca43"])
    assert set(tables.read_traces(spark, str(tmp_path / "r")).columns) == {"idx", "time", "Mg24_Ca43", "sample"}


def test_statistics_are_read_as_exported(spark, tmp_path):
    long = spark.createDataFrame([("mean", "a", 0, 1.5, None), ("std", "a", 0, 0.5, 2.0)], "statistic string, sample string, rep int, Ca43 double, Mg24 double")
    tables.write_stats(long, str(tmp_path / "s"))
    assert sorted(map(tuple, tables.read_stats(spark, str(tmp_path / "s")).collect())) == [("mean", "a", 0, 1.5, None), ("std", "a", 0, 0.5, 2.0)]


def test_statistics_of_a_subset_with_times(spark, tmp_path):
    rows = [(s, i, i * 0.5, i * 0.5, float(i), i // 4 % 2 * (i // 8 + 1)) for s in ("a", "b", "STD1") for i in range(16)]
    s = Session(spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, ns int"), ["Ca43"])
    with pytest.raises(ValueError):
        s.statistics()
    s.filter_threshold(channel="Ca43", limit=5.0)
    s.filter_on(filt="Ca43_thresh_above")
    s.sample_stats(stats_=["mean", "n"])
    got = s.statistics(subset="All_Samples", ablation_time=True, path=str(tmp_path / "s"))
    # Rows 4-7 and 12-15 are ablations; of the first the filter leaves 5-7, or 6-7 if the limit itself is out.
    left = [i for i in range(4, 8) if i >= 5]
    want = {(k, "a", r): v for r, m, n in ((0, sum(left) / len(left), len(left)), (1, 13.5, 4)) for k, v in (("mean", m), ("n", n))}
    assert got.columns == ["statistic", "sample", "rep", "Ca43", "seconds"]
    assert {(r.statistic, r.sample, r.rep): r.Ca43 for r in got.collect()} == want | {(k, "b", r): v for (k, _, r), v in want.items()}
    assert {r.seconds for r in got.collect()} == {1.5}
    assert sorted(map(tuple, tables.read_stats(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, got.collect()))
    s.make_subset(samples=["b"], name="one")
    s.sample_stats(stats_=["mean"], each_trace=False)
    whole = s.statistics(subset="one", ablation_time=True).collect()
    assert [tuple(r) for r in whole] == [("mean", "b", sum(range(5, 16)) / 11, 3.0)]
    assert s.statistics().columns == ["statistic", "sample", "Ca43"] and s.log[-1]["step"] == "sample_stats"
