"""The registered corpus queries against their SQL, other libraries and brute force, on whole tables."""

import hashlib
import itertools
import os
import re
from zlib import crc32

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import license_scan, pii, queries, quality

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.fixture(scope="module")
def docs(duck):
    return duck.execute("SELECT doc_id, text, source FROM documents").fetchall()


def rows_of(df):
    return [r.asDict() for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    plain = lambda rows: sorted(tuple("null" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain(df.select(*columns).collect()) == plain(want)


@pytest.mark.parametrize("d", [DATA, "/root/testdata/sf0.01"])
def test_bpe_is_the_library_s(spark, d):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()
    t = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for i, text in docs:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want[i] = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_bpe(spark, d).collect()} == want


def test_quality_tells_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    got = queries.op2_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality"), "doc_id", "left").toPandas()
    assert len(got) == spark.read.parquet(f"{d}/documents.parquet").count()
    assert got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    assert all(h == (crc32(str(i).encode()) % 4 == 2) for i, h in zip(got.doc_id, got.held_out, strict=True))
    seen = got[got.held_out & got.quality.notna()]
    good, bad = seen[seen.quality == 1].score.to_numpy(), seen[seen.quality == 0].score.to_numpy()
    assert (good[:, None] > bad).mean() > 0.9
    assert (seen.predicted == seen.quality).mean() > 0.85


def test_quality_never_learns_from_held_out_labels(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    assert np.array_equal(quality.train(d, labels), quality.train(d, turned))


def test_license_base(spark, docs):
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, DATA).collect()}
    assert len(got) == len(docs)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, text, _ in docs:
        ws, found = word.findall((text or "").translate(lower)), []
        for phrase, label in license_scan.PHRASES:
            p = phrase.split()
            found += [(k, label) for k in range(len(ws)) if ws[k : k + len(p)] == p]
        r = got[i]
        starts = [k for k, _ in found]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(ws), len(found), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in found})) and {x for _, x in found} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert any(r.n_base for r in got.values())


def test_pii_keeps_formats_and_links(spark, docs):
    got = {r.doc_id: r for r in queries.op7_pii(spark, DATA).collect()}
    assert len(got) == len(docs)
    names = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
    moved: dict[str, set] = {}
    for i, text, _ in docs:
        new = got[i].text
        assert (new is None) == (text is None)
        if text is None:
            continue
        if not any(got[i][f"n_{k}"] for k in pii.KINDS):
            assert new == text
            continue
        for a, b in zip(names.findall(text), names.findall(new), strict=True):
            assert len(a) == len(b) and a.partition("@")[2] == b.partition("@")[2]
            moved.setdefault(a, set()).add(b)
    assert moved and all(len(x) == 1 for x in moved.values()), "equal values have one pseudonym"
    assert len({next(iter(x)) for x in moved.values()}) == len(moved), "different ones never meet"


def test_ann_recall_and_scores(spark):
    d = "/root/testdata/sf0.1"
    table = pd.read_parquet(f"{d}/embeddings.parquet").dropna()
    x, ids = np.stack(table.embedding.to_numpy()).astype(np.float64), table.vec_id.to_numpy()
    norms = np.linalg.norm(x, axis=1)
    keep = np.isfinite(norms) & (norms > 0)
    x, ids, norms = x[keep], ids[keep], norms[keep]
    got = {}
    for r in queries.op8_ann(spark, d).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    assert set(got) == {int(ids[k]) for k in asked}
    hits = 0
    for k in asked:
        near = x @ x[k] / norms / norms[k]
        near[k] = -9
        order = np.lexsort((ids, -near))[:5]
        mine = sorted(got[int(ids[k])])
        assert [r for r, *_ in mine] == [1, 2, 3, 4, 5] and [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        place = {int(i): n for n, i in enumerate(ids)}
        assert all(abs(near[place[i]] - s) < 1e-12 for _, i, s in mine)
        hits += len({int(ids[j]) for j in order} & {i for _, i, _ in mine})
    assert hits / (5 * len(asked)) >= 0.9


def brute_fingerprint(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not ws:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(ws[k : k + 4]).encode(), 42) for k in range(max(1, len(ws) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    """Smallest key that each key reaches, all pairs compared."""
    root = {k: k for k in fps}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in itertools.combinations(sorted(fps), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 4:
            p, q = sorted((top(a), top(b)))
            root[q] = p
    return {k: top(k) for k in fps}


def test_simhash_is_brute_force(spark):
    d = "/root/testdata/sf0.01"
    fps = {i: brute_fingerprint(t) for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{d}/documents.parquet'").fetchall()}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op10_simhash(spark, d).collect()}
    roots = brute_components(fps)
    assert got == {k: (f"{f:016x}", roots[k]) for k, f in fps.items()}


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    """Each stage on what its predecessor kept, written and read again."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    space = re.compile(r"[\x20\x09-\x0D]")
    t = Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))
    t.no_truncation()
    t.no_padding()
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "SimHash near-dedup", "source mixing", "BPE encoding"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = rows_of(docs)
        stage(spark, docs, DATA).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = rows_of(docs)
        ids = sorted(r["doc_id"] for r in after)
        if k < 4:
            assert docs.columns == corpus_pipeline.COLUMNS
        if k == 0:
            kept = {r.doc_id for r in queries.op2_quality(spark, DATA).where("predicted = 1").collect()}
            assert set(ids) == kept and 0 < len(kept) < len(before)
        elif k == 1:
            groups = {}
            for r in before:
                groups.setdefault(space.sub("", r["text"] or ""), []).append((-len(r["text"] or ""), r["doc_id"]))
            assert ids == sorted(min(g)[1] for g in groups.values())
        elif k == 2:
            roots = brute_components({r["doc_id"]: brute_fingerprint(r["text"]) for r in before})
            assert ids == sorted(set(roots.values()))
        elif k == 3:
            duck = duckdb.connect()
            duck.register("documents", pd.DataFrame(before))
            sql = queries.ORACLE_SQL["op4_mixing"]
            want = {i: (taken // size if size else None) for i, size, taken in duck.execute(f"SELECT doc_id, size, taken FROM ({sql})").fetchall()}
            counts = {i: ids.count(i) for i in want}
            assert all(counts[i] == n for i, n in want.items() if n is not None) and sum(counts.values()) == len(ids)
        else:
            text = {r["doc_id"]: r["text"] for r in before}
            assert ids == sorted(r["doc_id"] for r in before)
            assert all(r["ids"] == t.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"]) for r in after)
