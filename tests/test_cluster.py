"""Clusters by cells against dense versions that compare all rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.operators import cluster, masks, segment
from tracewright.plans.session import Session, reproduced

NAMES = ["x", "y", "z"]


def frame(spark, groups):
    """groups: {sample: array of rows}."""
    n = next(iter(groups.values())).shape[1]
    rows = [(s, i, *map(float, r)) for s, x in groups.items() for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "sample string, idx int, " + ", ".join(f"{c} double" for c in NAMES[:n])).repartition(5), NAMES[:n]


def labels(df, n):
    out = {}
    for r in df.collect():
        out.setdefault(r.sample, {})[r.idx] = r.cluster
    return {s: [d[i] for i in range(len(d))] for s, d in out.items()}


def scaled(x):
    return (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1) if x.shape[1] > 1 else x


def brute_dbscan(x, eps, least):
    d2 = ((x[:, None] - x) ** 2).sum(axis=2)
    near = d2 <= eps**2
    core = near.sum(axis=1) >= least
    label, n = np.full(len(x), -1), 0
    for i in np.flatnonzero(core):
        if label[i] >= 0:
            continue
        label[i], open_ = n, [i]
        while open_:
            for j in np.flatnonzero(near[open_.pop()] & (label < 0)):
                label[j] = n
                if core[j]:
                    open_.append(j)
        n += 1
    order = sorted(range(n), key=lambda k: x[label == k, 0].mean())
    return [order.index(k) if k >= 0 else -1 for k in label.tolist()]


def blobs(rng, n, width):
    centres = rng.uniform(-5, 5, (4, width))
    return np.concatenate([centres[rng.integers(0, 4, n)] + 0.3 * rng.standard_normal((n, width)), rng.uniform(-8, 8, (n // 5, width))])


@pytest.mark.parametrize("width,eps", [(1, 0.15), (2, 0.3), (3, 0.5)])
def test_dbscan_is_brute_force(spark, width, eps):
    rng = np.random.default_rng(width)
    groups = {f"s{k}": blobs(rng, 150, width) for k in range(3)}
    df, names = frame(spark, groups)
    got = labels(cluster.clustered_by_sample(df, names, "dbscan", eps=eps, least=5), width)
    for s, x in groups.items():
        assert got[s] == brute_dbscan(scaled(x), eps, 5)
        assert len(set(got[s])) > 1


def test_dbscan_of_a_hot_sample(spark):
    """Equal rows in thousands, and a chain that joins two crowds: no row meets all others."""
    x = np.array([[0.0]] * 4000 + [[10.0]] * 4000 + [[k * 0.4] for k in range(1, 25)] + [[50.0]] * 3)
    df, names = frame(spark, {"a": x})
    got = labels(cluster.clustered_by_sample(df, names, "dbscan", eps=0.5, least=3), 1)["a"]
    assert set(got[:8024]) == {0} and set(got[8024:]) == {1}


def test_dbscan_shrinks_to_a_number(spark):
    x = np.array([[v + 0.01 * k] for v in (0.0, 1.0, 2.2, 9.0) for k in range(8)])
    df, names = frame(spark, {"a": x})
    got = labels(cluster.clustered_by_sample(df, names, "dbscan", eps=1.4, least=3, n_clusters=3), 1)["a"]
    assert len(set(got)) == 3


def brute_shift(x, bw):
    """Means start at each cell's mean; dense."""
    cells = {}
    for r in x:
        cells.setdefault(tuple(np.floor(r / bw)), []).append(r)
    rest = []
    for rows in cells.values():
        p = np.mean(rows, axis=0)
        for _ in range(cluster.ROUNDS):
            near = x[((x - p) ** 2).sum(axis=1) <= bw**2]
            new = near.mean(axis=0)
            still = np.abs(new - p).max() < cluster.REST * bw
            p = new
            if still:
                break
        rest.append((-len(near), tuple(p)))
    kept = []
    for _, p in sorted(rest):
        if all(((np.array(p) - c) ** 2).sum() > bw**2 for c in kept):
            kept.append(np.array(p))
    at = ((x[:, None] - np.stack(kept)) ** 2).sum(axis=2).argmin(axis=1)
    order = sorted(set(at.tolist()), key=lambda k: x[at == k, 0].mean())
    return [order.index(k) for k in at.tolist()]


@pytest.mark.parametrize("width,bw", [(1, 1.0), (2, 0.8)])
def test_mean_shift_is_brute_force(spark, width, bw):
    rng = np.random.default_rng(width + 5)
    groups = {f"s{k}": blobs(rng, 120, width) for k in range(2)}
    df, names = frame(spark, groups)
    got = labels(cluster.clustered_by_sample(df, names, "meanshift", bandwidth=bw), width)
    for s, x in groups.items():
        assert got[s] == brute_shift(scaled(x), bw)


def test_bandwidth_of_a_small_sample_is_of_all_its_rows(spark):
    x = blobs(np.random.default_rng(1), 100, 2)
    df, names = frame(spark, {"a": x})
    d = np.sort(np.sqrt(((x[:, None] - x) ** 2).sum(axis=2)), axis=1)
    want = d[:, int(np.ceil(cluster.NEAREST * len(x))) - 1].mean()
    assert cluster.bandwidths(df, names).first().bw == pytest.approx(want, rel=1e-6)


def brute_means(x, k):
    c = x[np.lexsort((np.arange(len(x)), *x.T[:0:-1], x[:, 0]))[((np.arange(k) + 0.5) * len(x) / k).astype(int)]]
    for _ in range(cluster.ROUNDS):
        at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
        new = np.stack([x[at == i].mean(axis=0) if (at == i).any() else c[i] for i in range(k)])
        if np.abs(new - c).max() <= 1e-12:
            break
        c = new
    at = ((x[:, None] - c) ** 2).sum(axis=2).argmin(axis=1)
    order = sorted(set(at.tolist()), key=lambda j: x[at == j, 0].mean())
    return [order.index(j) for j in at.tolist()]


@pytest.mark.parametrize("width,k", [(1, 3), (2, 4)])
def test_k_means_is_brute_force(spark, width, k):
    rng = np.random.default_rng(width)
    groups = {f"s{j}": blobs(rng, 80, width) for j in range(2)}
    df, names = frame(spark, groups)
    got = labels(cluster.clustered_by_sample(df, names, "kmeans", k=k), width)
    for s, x in groups.items():
        assert got[s] == brute_means(scaled(x), k)


def test_nulls_and_few_rows(spark):
    rows = [("a", i, float(i % 2 * 10)) for i in range(12)] + [("a", 12, None), ("a", 13, float("nan"))] + [("b", i, 1.0) for i in range(3)]
    df = spark.createDataFrame(rows, "sample string, idx int, x double").withColumn("k", F.lit("kept"))
    for method, how in (("meanshift", {}), ("kmeans", {"k": 2}), ("dbscan", {"eps": 1.0})):
        out = {(r.sample, r.idx): r for r in cluster.clustered_by_sample(df, ["x"], method, **how).collect()}
        assert len(out) == len(rows) and all(r.k == "kept" for r in out.values())
        assert [out["a", i].cluster for i in range(14)] == [0, 1] * 6 + [-2, -2] and {out["b", i].cluster for i in range(3)} == {-2}
        assert cluster.clustered_by_sample(df.where("false"), ["x"], method, **how).collect() == []
    with pytest.raises(ValueError):
        cluster.clustered_by_sample(df, ["x"], "nonsense")


def test_population_classifiers(spark):
    x = np.array([[0.0, 0.0]] * 30 + [[9.0, 1.0]] * 30 + [[20.0, 50.0]] * 30) + np.random.default_rng(0).normal(0, 0.1, (90, 2))
    df, names = frame(spark, {"a": x})
    want = [0] * 30 + [1] * 30 + [2] * 30
    for how in ({"k": 3}, {"method": "meanshift", "bandwidth": 0.5}):
        got = cluster.Classifier(names, **how).fit(df).predict(df)
        assert labels(got, 2)["a"] == want
    # Every row is nearest to the mean of its own cluster: a fixed point of Lloyd's rounds.
    z = scaled(x)
    means = np.stack([z[np.array(want) == k].mean(axis=0) for k in range(3)])
    assert ((z[:, None] - means) ** 2).sum(axis=2).argmin(axis=1).tolist() == want


def test_principal_components_are_eigenvectors(spark):
    x = np.random.default_rng(4).standard_normal((200, 3)) @ np.array([[3, 1, 0], [0, 1, 0.5], [0, 0, 0.2]])
    df, names = frame(spark, {"a": x})
    out, loadings = cluster.principal_components(df, names, 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    for j in range(2):
        v = vectors[:, np.argsort(-values)[j]]
        v = v * np.sign(v[np.abs(v).argmax()])
        assert np.allclose(loadings[:, j], v, atol=1e-6)
        got = [r[0] for r in out.orderBy("idx").select(f"pc{j + 1}").collect()]
        assert np.allclose(got, (x - x.mean(axis=0)) @ v, atol=1e-6)


def brute_cut(x):
    """The cut between two clusters with the least squares, of all cuts of the sorted values."""
    s = np.sort(x)
    return min(range(1, len(s)), key=lambda k: s[:k].var() * k + s[k:].var() * (len(s) - k)), s


def test_autorange_cuts_and_components(spark):
    """The upper cluster is that of all cuts with the least squares; signal and background lie on their own sides of it, and what lies between is the transition."""
    t = np.arange(120.0)
    shape = 1 / (1 + np.exp(-(t - 30) / 0.8)) - 1 / (1 + np.exp(-(t - 90) / 0.8))
    v = np.random.default_rng(2).poisson(50 + 20_000 * shape).astype(float)
    df = spark.createDataFrame([("a", i, float(t[i]), float(v[i])) for i in range(120)], "sample string, idx int, time double, v double")
    rows = segment.components(df, "v").orderBy("idx").collect()
    smooth = np.array([r.smooth for r in rows])
    k, s = brute_cut(smooth)
    assert [r.upper for r in rows[1:]] == [bool(x >= s[k]) for x in smooth[1:]]
    assert all(r.sig + r.bkg + r.trn == 1 for r in rows)
    assert all(r.upper for r in rows if r.sig) and not any(r.upper for r in rows if r.bkg)
    assert all(r.sig for r in rows[45:80]) and all(r.bkg for r in rows[:20]) and all(r.bkg for r in rows[105:])
    plain = segment.segmented(df, "v").orderBy("idx").collect()
    assert [(r.sig, r.bkg, r.trn) for r in plain] == [(r.sig, r.bkg, r.trn) for r in rows]
    slope = lambda x: float(np.polyfit(np.arange(-3, 4), x, 1)[0])
    assert all(rows[i].gradient == pytest.approx(abs(slope(v[i - 3 : i + 4])), rel=1e-6) or rows[i].gradient == pytest.approx(abs(float(np.polyfit(np.arange(-2, 3), v[i - 2 : i + 3], 1)[0])), rel=1e-6) for i in range(5, 115))
    short = df.where("idx < 5")
    assert [(r.smooth, r.sig, r.bkg) for r in segment.components(short, "v").collect()] == [(None, False, True)] * 5


def test_combinations():
    assert len(cluster._around(1, 1)) == 3 and len(cluster._around(2, 1)) == 9
    assert {o for o in cluster._around(2, 2)} == set(itertools.product(range(-2, 3), repeat=2))


def shifts(x, bandwidth):
    """Mean shift from every row, dense; the number of centres more than a bandwidth apart."""
    c = x.copy()
    for _ in range(200):
        new = np.stack([x[((x - p) ** 2).sum(axis=1) <= bandwidth**2].mean(axis=0) for p in c])
        if np.abs(new - c).max() < 1e-9:
            break
        c = new
    kept = []
    for p in c:
        if all(((p - q) ** 2).sum() > bandwidth**2 for q in kept):
            kept.append(p)
    return sorted(kept, key=lambda p: p[0])


def plateaus(spark, n=120):
    """One channel on four levels, over two samples, with rows that are null, NaN or filtered out."""
    rng = np.random.default_rng(8)
    v = np.repeat([10.0, 50.0, 200.0, 400.0], n // 4) + rng.normal(0, 1, n)
    rows = [("ab"[i % 2], i // 2, float(i), float(i), None if i == 3 else float("nan") if i in (8, 65) else float(x), 1) for i, x in enumerate(v)]
    return spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, ns int"), v


@pytest.mark.parametrize("level", ["sample", "population"])
@pytest.mark.parametrize(("method", "how", "labels"), [("kmeans", {"clusters": 4}, 4), ("kmeans", {"clusters": 2}, 2), ("meanshift", {"bandwidth": 0.2}, 4), ("meanshift", {"bandwidth": 30.0, "normalise": False}, 4), ("meanshift", {"bandwidth": 60.0, "normalise": False}, 3)])
def test_clusters_by_the_asked_method_at_both_levels(spark, level, method, how, labels):
    df, v = plateaus(spark)
    s = Session(df, ["Ca43"])
    names = s.filter_clustering(channels=["Ca43"], method=method, level=level, **how)
    assert [n.split(":")[1] for n in names] == [f"Ca43_{method}_{k}" for k in range(labels)]
    got = {(r["sample"], r.idx): [k for k, n in enumerate(names) if r[masks.column_of(n)]] for r in s.df.collect()}
    if method == "meanshift":
        x = np.delete(v, [3, 8, 65])[:, None]
        scale = 1.0 if not how.get("normalise", True) else x.std()
        assert len(shifts(x / scale, how["bandwidth"])) == labels
    for i, x in enumerate(v):
        mine = got["ab"[i % 2], i // 2]
        if i in (3, 8, 65):
            assert mine == []
        elif labels == 4:
            assert mine == [[10, 50, 200, 400].index(min([10, 50, 200, 400], key=lambda p: abs(p - x)))]
        else:
            assert len(mine) == 1


def test_population_says_what_it_cannot(spark):
    df, _ = plateaus(spark)
    s = Session(df, ["Ca43"])
    with pytest.raises(ValueError):
        s.filter_clustering(channels=["Ca43"], method="dbscan", level="population")
    with pytest.raises(TypeError):
        s.filter_clustering(channels=["Ca43"], method="kmeans", level="population", eps=3.0)
    with pytest.raises(ValueError):
        s.filter_clustering(channels=["Ca43"], level="all")
    assert s.filter_clustering(channels=["Ca43"], method="kmeans", level="population", min_data=1000) == []
    assert s.log == [{"step": "filter_clustering", "args": {"channels": ["Ca43"], "method": "kmeans", "level": "population", "min_data": 1000}}]


@pytest.mark.parametrize("n", [60, 3000])
def test_bandwidth_of_all_rows(spark, n):
    """Within a cell's width of the dense estimate; exact where rows ask one by one."""
    rng = np.random.default_rng(n)
    x = np.concatenate([rng.normal(0, 1, (n // 2, 2)), rng.normal(6, 2, (n - n // 2, 2))])
    df, values = frame(spark, {"a": x})
    got = cluster.bandwidths(df, values).first().bw
    d = np.sqrt(((x[:, None] - x) ** 2).sum(axis=2))
    want = np.sort(d, axis=1)[:, int(np.ceil(0.3 * n)) - 1].mean()
    assert got == pytest.approx(want, rel=1e-9 if n <= cluster.CELLS else 0.03)
    assert cluster.bandwidths(df, values, 50).first().bw == pytest.approx(want, rel=0.15)


def test_autorange_makes_the_total_itself(spark, tmp_path):
    t = np.arange(120.0)
    shape = 1 / (1 + np.exp(-(t - 30) / 0.8)) - 1 / (1 + np.exp(-(t - 90) / 0.8))
    rng = np.random.default_rng(2)
    rows = [("a", i, float(t[i]), float(t[i]), *(float(x) for x in rng.poisson([40 + 15_000 * shape[i], 10 + 5000 * shape[i]]))) for i in range(120)]
    df = spark.createDataFrame(rows, "sample string, idx int, time double, u_time double, Ca43 double, Mg24 double")
    s = Session(df, ["Ca43", "Mg24"])
    s.autorange()
    s.filter_threshold(channel="Ca43", limit=1000.0)
    want = [(r.sig, r.bkg, r.ns) for r in s.df.orderBy("idx").collect()]
    plain = segment.segmented(df.withColumn("total_counts", F.col("Ca43") + F.col("Mg24")), "total_counts").orderBy("idx").collect()
    assert [w[:2] for w in want] == [(r.sig, r.bkg) for r in plain] and any(w[0] for w in want)
    s.minimal_export(str(tmp_path), channels=["Ca43"])
    again = reproduced(spark, str(tmp_path))
    assert again.channels == ["Ca43"] and [(r.sig, r.bkg, r.ns) for r in again.df.orderBy("idx").collect()] == want
