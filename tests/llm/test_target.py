"""Importance resampling, clustering and the language model against plain versions, and their edges."""

import hashlib
import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from tracewright.llm import centroids, importance, lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_resample(docs, target, percent=10, least=20, most=1, buckets=10_000, seed=2024):
    """(doc_id, n_features, weight, score, rank) of every row."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

    def of(text):
        ws = word.findall((text or "").translate(LOWER))
        return len(ws), [crc32(" ".join(ws[i : i + n]).encode()) % buckets for n in range(1, most + 1) for i in range(len(ws) - n + 1)]

    own, s, t = [(i, *of(x)) for i, x in docs], Counter(), Counter()
    for _, _, f in own:
        s.update(f)
    for x in target:
        t.update(of(x)[1])
    total, whole = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (whole + buckets))))
    rows = []
    for i, n, f in own:
        w = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, n, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2]))
    drawn = Counter()
    rank = {}
    for k, r in enumerate(able[: percent * len(able) // 100], 1):
        rank.setdefault(r, []).append(k)
    out = []
    for r in rows:
        ranks = rank.get(r, [])
        k = drawn[r]
        drawn[r] += 1
        out.append((r[0], r[2], r[3], r[4], ranks[k] if k < len(ranks) else None))
    return sorted(out, key=str)


def texts(rng, n, words=60):
    return [" ".join(f"W{rng.zipf(1.4) % 500}" for _ in range(rng.integers(0, words))) for _ in range(n)]


@pytest.mark.parametrize("how", [{}, {"percent": 37, "least": 3, "most": 2, "buckets": 64, "seed": 5}, {"percent": 100, "least": 0}, {"percent": 0}, {"most": 3, "least": 5, "percent": 50}])
def test_resample_is_the_plain_version(spark, how):
    rng = np.random.default_rng(3)
    docs = list(zip(rng.integers(-(1 << 62), 1 << 62, 300).tolist(), texts(rng, 300), strict=True))
    docs += [(7, "a b " * 30)] * 9 + [(None, "x " * 25), (None, None), (8, None), (9, ""), (10, "ÀB, c!" * 3), (11, "long word " * 150_000)]
    target = [*texts(rng, 20), None, ""]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame([(x,) for x in target], "text string"), **how)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_resample(docs, target, **how)


def test_resample_ties_and_hot_rows(spark):
    """Thousands of rows that share all but their number, across the last place that is drawn."""
    docs = [(5, "same words " * 15)] * 3000 + [(i, "other text " * 15) for i in range(100)]
    got = importance.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("same",)], "text string"), percent=50).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == 3100 and ranks == list(range(1, 1551))
    scores = {r["rank"]: r["score"] for r in got}
    assert all(scores[k] >= scores[k + 1] for k in range(1, 1550))


def test_resample_of_nothing_and_other_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(empty, empty.select("text")).collect() == []
    clash = spark.createDataFrame([(1, "a b", 3, "x", 4)], "doc_id long, text string, score int, rank string, row int")
    assert importance.resample(clash, empty).columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert importance.resample(clash, empty, least=1, percent=100).first()["rank"] == 1


def plain_clusters(rows, k, rounds, scale=64, seed=1):
    x = [(i, [math.floor(scale * c) for c in v]) for i, v in rows]
    first = sorted(x, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    cs = [v for _, v in first]
    far = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b, strict=True))
    own = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        of = {}
        for _, v in x:
            of.setdefault(own(v)[1], []).append(v)
        cs = [[sum(col) // len(of[j]) for col in zip(*of[j], strict=True)] if j in of else c for j, c in enumerate(cs)]
    at = [(i, *own(v)[::-1]) for i, v in x]
    sums = Counter()
    for _, j, d in at:
        sums[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cs]
    return sorted(((i, j, d, sums[j], sum(sums.values()), sha[j]) for i, j, d in at), key=str)


@pytest.mark.parametrize(("size", "k", "rounds", "spread"), [(2, 5, 6, 3), (1, 16, 4, 20), (3, 40, 5, 2), (64, 16, 3, 1), (2, 1, 2, 5), (2, 400, 2, 4), (4, 7, 0, 9)])
def test_clusters_are_brute_force(spark, size, k, rounds, spread):
    """Small whole numbers, so that ties are many; rows repeat."""
    rng = np.random.default_rng(size + k)
    rows = [(int(i), [float(c) for c in rng.integers(-spread, spread + 1, size) / 64]) for i in rng.integers(0, 250, 300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = centroids.cluster(df, k=k, rounds=rounds, size=size)
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_clusters(rows, k, rounds)


def test_bounds_spare_work(spark):
    """In the last of several rounds most vectors of plain groups measure few centroids."""
    rng = np.random.default_rng(0)
    x = (rng.integers(-2000, 2000, (30, 8))[rng.integers(0, 30, 5000)] + rng.integers(-20, 21, (5000, 8))).astype(np.int64)
    cs, seen = x[:30].copy(), []
    at = upper = lower = None
    before = None
    for _ in range(6):
        m = centroids.Moved(cs, before)
        looked = []
        look = m.look
        m.look = lambda rows, cols, look=look, looked=looked: looked.append(len(rows) * len(cols)) or look(rows, cols)
        at, upper, lower = m.assign(x, at, upper, lower)
        d = ((x[:, None] - cs) ** 2).sum(axis=2)
        assert (at == d.argmin(axis=1)).all()
        seen.append(sum(looked))
        before, cs = cs, np.stack([x[at == j].sum(axis=0) // max(1, (at == j).sum()) if (at == j).any() else cs[j] for j in range(30)])
    assert seen[0] == 150_000 and seen[-1] < 15_000


def test_cluster_edges(spark):
    schema = "vec_id long, embedding array<float>, cluster int, distance string"
    rows = [(1, [1.0, 2.0], 0, ""), (2, [1.0], 0, ""), (3, None, 0, ""), (4, [1.0, None], 0, ""), (5, [1.0, float("nan")], 0, ""), (6, [float("inf"), 1.0], 0, ""), (7, [1e30, 1.0], 0, ""), (None, [0.5, 0.5], 0, ""), (1, [1.0, 2.0], 0, "")]
    got = sorted((tuple(r)[:3] for r in centroids.cluster(spark.createDataFrame(rows, schema), k=2, size=2).collect()), key=str)
    assert got == sorted([(1, 0, 0), (1, 0, 0), (None, 0, 32**2 + 96**2), (7, None, None)], key=str) or {r[0] for r in got} == {1, 7, None}
    assert [r for r in got if r[0] == 7] == [(7, None, None)] and len(got) == 4
    assert centroids.cluster(spark.createDataFrame([], schema), size=2).collect() == []
    assert centroids.cluster(spark.createDataFrame(rows[1:6], schema), size=2).collect() == []


def plain_model(docs, order=2):
    """(n_tokens, n_known, N, base, score) of every row, with exact counts quantised."""
    toks = [[w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").translate(LOWER)) if w] + ["\n"] for _, t in docs]
    held = [i is not None and crc32(str(i).encode()) % 10 == 0 for i, _ in docs]
    counts = Counter()
    for h, ws in zip(held, toks, strict=True):
        full = ["\n", *ws]
        if not h:
            counts.update(tuple(full[e - n + 1 : e + 1]) for e in range(1, len(full)) for n in range(1, order + 1) if e - n + 1 >= 0)
    one = {k[0]: n for k, n in counts.items() if len(k) == 1}
    total = sum(one.values())
    whole = total + 0.1 * (len(one) + 1)
    value = lambda *k: 1.5 * 4 ** ((counts[k].bit_length() - 1) // 2) if counts[k] else 0.0
    out = []
    for ws in toks:
        full, score = ["\n", *ws], 0.0
        for e in range(1, len(full)):
            p = (value(full[e]) + 0.1) / whole
            for n in range(2, order + 1):
                if e - n + 1 >= 0:
                    c = value(*full[e - n + 1 : e])
                    p = (min(value(*full[e - n + 1 : e + 1]), c, value(*full[e - n + 2 : e + 1])) + 4 * p) / (c + 4)
            score += math.log10(p)
        out.append((len(ws), sum(w in one for w in ws), total, sum(math.log10((one.get(w, 0) + 0.1) / whole) for w in ws), score))
    return out


def model_docs():
    rng = np.random.default_rng(5)
    docs = [(i, " ".join(f"T{rng.zipf(1.3) % 300}" for _ in range(rng.integers(0, 80)))) for i in range(200)]
    docs += [(i, "hot line " * 40) for i in range(200, 280)] + [(5, docs[5][1])] * 3
    return [*docs, (None, "new words"), (400, None), (401, ""), (402, "\t \n"), (403, "x" * 100_000 + " y"), (404, "one two three " * 130_000), (405, "Ünï ÀB c　d")]


@pytest.mark.parametrize(("order", "held"), [(2, None), (3, None), (1, None), (2, 0), (3, 0)])
def test_model_is_exact_counts_quantised(spark, monkeypatch, order, held):
    """With so large a filter that nothing is read that isn't there; broadcast, and asked for by blocks."""
    monkeypatch.setattr(lm, "HEAD", 50)
    if held is not None:
        monkeypatch.setattr(lm, "HELD", held)
        monkeypatch.setattr(lm, "BLOCK", 20_000)
    docs = model_docs()
    if order == 3:
        docs = [d for d in docs if d[0] != 404]
    got = lm.score(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), order=order, bits=64, probes=16).collect()
    want = Counter((i, *r[:3], *(f"{x:.9g}" for x in r[3:])) for (i, _), r in zip(docs, plain_model(docs, order), strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, f"{r.base_score:.9g}", f"{r.score:.9g}") for r in got) == want
    assert all(r.held_out == (r.doc_id is not None and crc32(str(r.doc_id).encode()) % 10 == 0) for r in got)


def test_filter_never_reads_less(spark):
    rng = np.random.default_rng(2)
    h = rng.integers(0, 1 << 63, 50_000, dtype=np.int64).view(np.uint64) * np.uint64(2)
    n = rng.zipf(1.5, 50_000) % 10**6 + 1
    shard = lm.shard_of(h, 7).astype(int)
    table = lm.Filter({i: lm.shard_bits(h[shard == i], n[shard == i]).tobytes() for i in range(7)}, 7)
    got = table.levels(h)
    assert (got >= lm.levels_of(n)).all() and (got > lm.levels_of(n)).mean() < 0.04
    assert (table.levels(h + np.uint64(1)) > 0).mean() < 0.04
    assert (lm.Filter({}, 3).levels(h) == 0).all()


def test_model_tells_seen_language_and_edges(spark):
    d = "/root/testdata/sf0.01"
    got = lm.score(spark.read.parquet(f"{d}/documents.parquet")).where("held_out").agg({"base_score": "sum", "score": "sum"}).first()
    assert got["sum(base_score)"] < got["sum(score)"] < 0
    empty = spark.createDataFrame([], "doc_id long, text string, score int, n int")
    assert lm.score(empty).collect() == [] and lm.score(empty).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    lone = lm.score(spark.createDataFrame([(i, "a") for i in range(2000) if crc32(str(i).encode()) % 10 == 0][:2], "doc_id long, text string")).first()
    assert (lone.n_known, lone.train_tokens, lone.base_score, lone.score) == (0, 0, 0.0, 0.0)
