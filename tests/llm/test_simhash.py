"""Links by multi-index hashing against all pairs, where buckets are crowded."""

import itertools

import numpy as np
import pytest

from tracewright.llm import simhash


def brute(fps, bits=4):
    """Smallest index that each fingerprint reaches, all pairs compared, in blocks."""
    x = np.array(fps, np.uint64)
    root = np.arange(len(x))
    pairs = []
    for at in range(0, len(x), 500):
        d = np.bitwise_count(x[at : at + 500, None] ^ x[None, :])
        a, b = np.nonzero(d <= bits)
        keep = a + at < b
        pairs += zip((a[keep] + at).tolist(), b[keep].tolist(), strict=True)

    def top(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for a, b in pairs:
        p, q = sorted((top(a), top(b)))
        root[q] = p
    return [int(top(k)) for k in range(len(x))]


def components(spark, fps, bits=4):
    rows = spark.createDataFrame([(k, int(np.uint64(v).view(np.int64))) for k, v in enumerate(fps)], "key long, fp long").repartition(8)
    got = {r.key: r.component_id for r in simhash.grouped(rows, bits).collect()}
    return [got[k] for k in range(len(fps))]


def flipped(rng, base, least, most):
    out = int(base)
    for b in rng.choice(64, rng.integers(least, most + 1), replace=False):
        out ^= 1 << int(b)
    return out


def crowded(seed, n):
    """Fingerprints that share a segment, groups of near copies with many members, chains, copies, strays."""
    rng = np.random.default_rng(seed)
    any_ = lambda k: [int(v) for v in rng.integers(0, 1 << 63, k)]
    out = [v << 22 & (1 << 64) - 1 | 12345 for v in any_(n)]  # all have the lowest segment
    for base in any_(4):
        out += [flipped(rng, base, 0, 2) for _ in range(n // 4)]
    v = any_(1)[0]
    for _ in range(60):
        v = flipped(rng, v, 4, 4)
        out.append(v)
    out += out[: n // 10] + any_(n) + [0, (1 << 64) - 1]
    return [out[k] for k in rng.permutation(len(out))]


@pytest.mark.parametrize("count,crowd", [(3, 16), (3, 1 << 30), (2, 16)])
def test_is_brute_force(spark, monkeypatch, count, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "MANY", 1 << 60 if count == 3 else 0)
    fps = crowded(count + crowd % 7, 300 if count == 3 else 60)
    assert components(spark, fps) == brute(fps)


def test_other_bits(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CROWD", 16)
    fps = crowded(5, 120)
    for bits in (0, 2, 3):
        assert components(spark, fps, bits) == brute(fps, bits)


def test_twenty_thousand_in_one_bucket(spark):
    """One segment is the same in 20,000 fingerprints, one group of near copies has 5,000 of them."""
    rng = np.random.default_rng(3)
    same = 77 << 42
    fps = [(int(v) & (1 << 42) - 1) | same for v in rng.integers(0, 1 << 62, 15_000)]
    base = fps[0]
    low = [1 << int(b) for b in range(42)]
    fps += [base ^ low[a] ^ low[b] ^ (low[c] if c != a else 0) for a, b, c in rng.integers(0, 42, (5_000, 3)).tolist()]
    assert components(spark, fps) == brute(fps)


def test_exploded_rows_are_not_broadcast(spark, monkeypatch):
    """Spark takes them to be as few as the fingerprints are, 108 KB for the balls of 3,000; the buckets have 360 KB."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "200k")
    plans, plain = [], simhash.durable

    def watched(df):
        out = plain(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0])
        return out

    monkeypatch.setattr(simhash, "durable", watched)
    rng = np.random.default_rng(3)
    fps = spark.createDataFrame([(int(x),) for x in set(rng.integers(0, 1 << 62, 3000).tolist())], "fp long")
    try:
        assert simhash.linked(fps, 4).count() == fps.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    found = 0
    for plan in plans:
        lines = [(len(x) - len(x.lstrip(" :+-*")), x) for x in plan.splitlines()]
        found += sum("Generate" in x for _, x in lines)
        for i, (depth, x) in enumerate(lines):
            if "BroadcastExchange" in x:
                below = itertools.takewhile(lambda l: l[0] > depth, lines[i + 1 :])  # noqa: B023
                assert not any("Generate explode" in y for _, y in below), plan
    assert found
