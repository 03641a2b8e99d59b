"""Traces in blocks with borders give what windows over whole traces give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import blocks, despike, frames, ranked, runs
from tracewright.plans.session import Session


@pytest.fixture(scope="module")
def traces(spark):
    """Traces of 1 to 400 rows: lengths at and around multiples of a block, spikes, nulls, long and short runs."""
    rng, rows = np.random.default_rng(11), []
    for s, n in enumerate([1, 2, 19, 20, 21, 39, 40, 41, 60, 137, 400, 61]):
        v = rng.poisson(200, n).astype(float)
        v[rng.random(n) < 0.05] *= 30
        m = np.repeat(rng.random(n) < 0.5, rng.integers(1, 30, n))[:n]
        if s == 11:
            m[:] = False
        for i in range(n):
            rows.append((f"s{s}", i, i * 0.5 + float(rng.random()) * 0.1, None if rng.random() < 0.03 else float(v[i]), float(rng.normal()), None if rng.random() < 0.02 else bool(m[i])))
    return spark.createDataFrame(rows, "sample string, idx int, time double, v double, w double, m boolean").repartition(5).cache()


def same(a, b, columns):
    rows = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select("sample", "idx", *[F.coalesce(F.col(c).cast("double"), F.lit(-1e9)) for c in columns]).collect())
    assert rows(a) == rows(b)


SIZE = 20


@pytest.mark.parametrize("win", [3, 4, 7])
def test_smooth_and_slopes(traces, win):
    same(blocks.smoothed(traces, "v", win, size=SIZE), traces.withColumn("smooth", frames.smoothed("v", win)), ["v", "smooth"])
    same(blocks.gradient_by_row(traces, "v", win, size=SIZE), traces.withColumn("gradient", frames.gradient_by_row("v", win)), ["gradient"])
    for mode in ("mid", "left", "right"):
        same(blocks.with_gradient(traces, "v", win, mode, size=SIZE), frames.with_gradient(traces, "v", win, mode), ["gradient"])
    r, pairs = frames.correlation("v", "w", win)
    same(blocks.correlation(traces, "v", "w", win, size=SIZE), traces.withColumn("r", r).withColumn("pairs", pairs), ["r", "pairs"])


@pytest.mark.parametrize("how", [{}, {"win": 5, "nlim": 2.0, "maxiter": 3}, {"exponent": -0.5, "step": 0.5, "maxiter": 3}])
def test_despiking(traces, how):
    t = traces.where("v IS NOT NULL OR idx >= 0")
    got, want = blocks.despiked(t, ["v", "w"], size=SIZE, **how), despike.despiked(t, ["v", "w"], **how)
    same(got, want, ["v", "w", "total_counts"])
    assert got.columns == want.columns


def test_runs(traces):
    same(blocks.number(traces, "m", start=3, size=SIZE), runs.number(traces, "m", start=3), ["run"])
    same(blocks.enumerated(traces, "m", size=SIZE), runs.enumerated(traces, "m"), ["ns"])
    for threshold in (1, 3, 12, 25, 100):
        for mode in ("include", "exclude"):
            same(blocks.defragmented(traces, "m", threshold, mode, size=SIZE), runs.defragmented(traces, "m", threshold, mode), ["defrag"])
        same(blocks.without_downhole(traces, "m", threshold, size=SIZE), runs.without_downhole(traces, "m", threshold), ["kept"])


def test_edges(spark, traces):
    with pytest.raises(ValueError):
        blocks.smoothed(traces, "v", 30, size=20)
    with pytest.raises(ValueError):
        blocks.defragmented(traces, "m", 3, "both")
    assert blocks.number(traces.where("idx < 0"), "m").collect() == []


def test_one_long_trace_is_many_tasks(spark):
    """No block has more than its rows and its borders, and the shuffle's keys are the blocks."""
    n = 300_000
    df = spark.range(n).select(F.lit("one").alias("sample"), F.col("id").alias("idx"), (F.col("id") * 0.1).alias("time"), F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("v"))
    rows = blocks.blocked(df, 5, size=10_000)
    sizes = rows.groupBy("__block").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("__own").cast("int")).alias("own")).collect()
    assert len(sizes) == 30 and all(r.own == 10_000 and r.n <= 10_010 for r in sizes)
    masked = df.withColumn("m", F.pmod(F.xxhash64(F.floor(F.col("idx") / 7)), F.lit(3)) == 0)
    got = blocks.number(masked, "m", size=10_000).agg(F.max("run"), F.sum("run")).first()
    m = np.array([r.m for r in masked.orderBy("idx").select("m").collect()])
    begins = m & ~np.concatenate([[False], m[:-1]])
    assert tuple(got) == (int(begins.sum()), int((np.cumsum(begins) * m).sum()))


def test_numbered_is_row_number(spark):
    rng = np.random.default_rng(1)
    keys = rng.permutation(5000)
    df = spark.createDataFrame([(int(k % 7), int(k)) for k in keys], "a int, b int").repartition(6)
    got = {r.b: r.idx for r in ranked.numbered(df, ["a", F.desc("b")]).collect()}
    want = {k: i for i, k in enumerate(sorted(keys.tolist(), key=lambda k: (k % 7, -k)))}
    assert got == want
    assert ranked.numbered(df.where("a > 9"), ["a"]).collect() == []


def test_a_session_in_blocks_is_one_without(spark):
    rng, rows = np.random.default_rng(3), []
    for s in ("a", "b STD"):
        shape = np.clip(np.sin(np.arange(260) / 20), 0, None) * 5000
        for i in range(260):
            rows.append((s, i, float(i), float(i), *(float(x) for x in rng.poisson([30 + shape[i], 10 + 0.3 * shape[i]]))))
    df = spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, Mg24 double")

    def run(block):
        s = Session(df, ["Ca43", "Mg24"], block=block)
        s.despike(exponent=-0.2, maxiter=3)
        s.autorange()
        s.filter_gradient(channel="Ca43", win=9, limit=50.0)
        s.filter_correlation(x="Ca43", y="Mg24", window=11, r_threshold=0.5)
        s.filter_threshold(channel="Mg24", limit=700.0)
        s.filter_on(filt="Mg24_thresh_above")
        s.filter_defragment(threshold=4)
        s.filter_exclude_downhole(threshold=2)
        out = s.stage()
        columns = sorted(c for c in out.columns if c not in ("sample", "idx"))
        grads = s.gradients(channels=["Ca43"], win=7).toPandas().sort_values(["sample", "idx"])["Ca43_gradient"]
        return columns, out.select("sample", "idx", *columns).toPandas().sort_values(["sample", "idx"]).reset_index(drop=True), grads.to_numpy(float)

    names, whole, slopes = run(None)
    again, blocked, same = run(40)
    assert names == again and len(names) > 15 and np.allclose(slopes, same, equal_nan=True)
    for c in names:
        a, b = (np.array([np.nan if x is None else float(x) for x in t[c]]) for t in (whole, blocked))
        assert np.allclose(a, b, equal_nan=True), c
