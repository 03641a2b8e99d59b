import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import merging, stats
from tracewright.plans.session import Session


def moments():
    """Skewness from sums of three powers."""
    sums = lambda s, x: s + np.array([len(x), x.sum(), (x**2).sum(), (x**3).sum()])

    def skew(s):
        n, a, b, c = s
        if not n:
            return float("nan")
        m = a / n
        v = b / n - m * m
        return (c / n - 3 * m * b / n + 2 * m**3) / v**1.5 if v > 0 else 0.0

    return merging.Statistic(lambda: np.zeros(4), sums, np.add, skew)


def test_a_hot_group_shuffles_states_only(spark):
    df = spark.range(0, 1_000_000, 1, 8).select(F.when(F.col("id") % 1000 == 0, "rare").otherwise("hot").alias("sample"), (F.pmod(F.xxhash64("id"), F.lit(1000)) / 100).alias("v"))
    got = {r["sample"]: r.v_skew for r in merging.merged(df, ["v"], {"skew": moments()}).collect()}
    x = df.toPandas()
    for k, g in x.groupby("sample"):
        z = (g.v - g.v.mean()) / g.v.std(ddof=0)
        assert got[k] == pytest.approx((z**3).mean(), abs=1e-8)
    plan = merging.merged(df, ["v"], {"skew": moments()})._jdf.queryExecution().executedPlan().toString()
    exchange, below = plan.index("Exchange"), plan.index("MapInPandas")
    assert exchange < below, "states are made before the shuffle"


def test_nulls_masks_and_names_in_a_log(spark):
    merging.register("skew", moments())
    try:
        rows = [("a", 1, float(v), i) for i, v in enumerate([1, 2, 9, 4])] + [("a", 1, None, 0), ("a", 1, float("nan"), 0), ("b", 2, 5.0, 0), (None, 3, 2.0, 0), (None, 3, 8.0, 9), ("c", 4, None, 1)]
        df = spark.createDataFrame(rows, "sample string, ns int, v double, k int").repartition(3)
        got = {r["sample"]: r for r in stats.sample_stats(df, ["v"], ["mean", "skew"], {"v": F.col("k") < 3}).collect()}
        want = lambda x: (((x - x.mean()) / x.std()) ** 3).mean()
        assert got["a"].v_skew == pytest.approx(want(np.array([1.0, 2.0, 9.0]))) and got["b"].v_skew == 0 and got[None].v_skew == 0 and got["c"].v_skew is None
        s = Session(df.withColumn("idx", F.monotonically_increasing_id()).withColumn("u_time", F.col("idx")), ["v"])
        s.sample_stats(stats_=["skew"], channels=["v"], filt=False)
        log = json.loads(json.dumps(s.log))
        again = Session(s.df, ["v"]).replay(log)
        table = lambda x: sorted((r["sample"] or "", r.ns, str(r.v_skew and round(r.v_skew, 9))) for r in x.stats.collect())
        assert table(again) == table(s)
    finally:
        del merging.STATISTICS["skew"]
    assert merging.merged(df.where("ns > 9"), ["v"], {"skew": moments()}).collect() == []
