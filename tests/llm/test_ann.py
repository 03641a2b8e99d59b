"""Nearest neighbours against exact search, where leaves are many and visits few."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import ann


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(8)


def found(df, every=50, k=5):
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % every == 0, k=k).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return {q: sorted(x) for q, x in got.items()}


def clustered(n, centres, width, spread, seed):
    rng = np.random.default_rng(seed)
    c = rng.standard_normal((centres, width))
    return c[rng.integers(0, centres, n)] + spread * rng.standard_normal((n, width))


def recall(got, x, asked, k=5):
    """Share of the k nearest that were found; every query has k in order, with its true scores."""
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    assert set(got) == set(asked)
    for q in asked:
        near = u @ u[q]
        near[q] = -9
        mine = got[q]
        assert [r for r, *_ in mine] == list(range(1, k + 1)), "k results, whatever the leaves hold"
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        assert all(abs(near[i] - s) < 1e-12 for _, i, s in mine)
        least = np.partition(near, -k)[-k]
        hits += sum(s >= least - 1e-12 for _, _, s in mine)
    return hits / (k * len(asked))


@pytest.mark.parametrize("seed", range(3))
def test_always_k(spark, seed):
    """Tight clusters and strays: leaves of one or two rows are visited on until k are found."""
    x = np.concatenate([clustered(2400, 40, 16, 0.01, seed), np.random.default_rng(seed + 9).standard_normal((30, 16))])
    x = x[np.random.default_rng(seed).permutation(len(x))]
    got = found(frame(spark, list(enumerate(x.tolist()))), every=3)
    assert recall(got, x, range(0, len(x), 3)) >= 0.9


def test_few_visits_of_many_leaves(spark, monkeypatch):
    """A table five times the sample, where under a fifth of the leaves is visited."""
    monkeypatch.setattr(ann, "SAMPLE", 4096)
    x = clustered(20_000, 300, 24, 0.35, 1)
    trees = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a: trees.append(fit(*a)) or trees[-1])
    got = found(frame(spark, list(enumerate(x.tolist()))))
    assert recall(got, x, range(0, len(x), 50)) >= 0.9
    assert trees[0].visits * 5 < trees[0].n_leaves, (trees[0].visits, trees[0].n_leaves)


def test_shards_and_blocks(spark, monkeypatch):
    """Leaves cut into several shards, and shards that queries meet in several blocks, give what whole ones do."""
    x = clustered(3000, 5, 8, 0.2, 4)
    df = frame(spark, list(enumerate(x.tolist())))
    want = found(df, every=10)
    monkeypatch.setattr(ann, "BLOCK", 16)
    monkeypatch.setattr(ann, "ASKS", 32)
    assert max(map(len, ann.shards_of({0: 100, 1: 3}, 2))) > 1
    assert found(df, every=10) == want


def test_tiny_and_huge_components(spark):
    rows = [(0, [1e-170, 0.0]), (1, [1e200, 1e200]), (2, [5e-324, 0.0]), (3, [1.7e308, -1.5e308]), (4, [3.0, 4.0]), (50, [0.0, 1e-300])]
    got = found(frame(spark, rows))
    assert [(i, pytest.approx(s, abs=1e-15)) for _, i, s in got[0]] == [(2, 1.0), (3, 1.7 / math.hypot(1.7, 1.5)), (1, math.sqrt(0.5)), (4, 0.6), (50, 0.0)]
    assert [(i, pytest.approx(s, abs=1e-15)) for _, i, s in got[50]] == [(4, 0.8), (1, math.sqrt(0.5)), (0, 0.0), (2, 0.0), (3, -1.5 / math.hypot(1.7, 1.5))]


def test_lengths_are_tables_of_their_own(spark):
    rows = [(i, [1.0, float(i)]) for i in range(0, 60)] + [(100 + i, [1.0, float(i), 0.0]) for i in range(0, 4)] + [(150, [1.0])]
    got = found(frame(spark, rows))
    assert set(got) == {0, 50, 100} and [len(got[q]) for q in (0, 50, 100)] == [5, 5, 3]
    assert {i for _, i, _ in got[100]} == {101, 102, 103}


def test_hot_vector_and_own_class(spark):
    """A third of the rows is one vector; a query among its copies isn't its own neighbour."""
    x = clustered(900, 30, 6, 0.1, 2).tolist()
    rows = [(i, [1.0] * 6 if i % 3 == 0 else x[i]) for i in range(900)]
    got = found(frame(spark, rows + rows[:30]))
    assert set(got) == set(range(0, 900, 50)) and all(len(v) == 5 and q not in {i for _, i, _ in v} for q, v in got.items())
    assert [i for _, i, _ in got[150]] == [0, 3, 6, 9, 12] and [i for _, i, _ in got[0]] == [3, 6, 9, 12, 15]
