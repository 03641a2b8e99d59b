"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for every operator and stage."""

import hashlib
import io
import math
import random
import re
import tracemalloc
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tracewright.llm import ann, bpe, chat, common, exact_dedup, license_scan, mixing, pii, quality, queries, simhash, warc

PATH = public_tokenizers.path(queries.TOKENIZER)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars int"
LONG = "word " * 60_000 + "end"
ROWS = [
    (1, "Hello there, general public license", "en", "web", 35),
    (1, "Hello there, general public license", "en", "web", 35),
    (2, "Hello  there,\ngeneral public license", "en", "web", 36),
    (None, "Hello there, general public license", None, None, None),
    (3, None, "en", "web", 0),
    (4, "", "en", None, 0),
    (5, " \t\n", "en", "code", 3),
    (6, LONG, "en", "code", len(LONG)),
    (None, None, None, None, None),
    (7, "née Ωmega ΑΣ 漢字 \U0001f600 <|endoftext|> \x1c\x85\u3000 it's 123", "fr", "web", 40),
]
#: Columns that some operator adds or uses within.
CLASH = ["ids", "decoded", "score", "predicted", "held_out", "keep_id", "kept", "group_size", "text_sha256", "size", "source_size", "target", "taken", "copies", "n_words", "phrases", "spans", "pseudonymised", "fingerprint", "component_id", "key", "fp", "root", "k", "t", "h", "KEPT"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 0, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (99, 1, 1)], "doc_id long, quality int, toxic int")


def fingerprinted(d):
    return simhash.near_groups(d)


OPERATORS = {
    "bpe": lambda d: bpe.code(d, PATH),
    "quality": lambda d: quality.score(d, np.zeros(1 << quality.BITS, np.float32)),
    "license": license_scan.scan,
    "mixing": mixing.mix,
    "pii": lambda d: pii.pseudonymise(d, "k"),
    "exact": exact_dedup.exact_groups,
    "simhash": fingerprinted,
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_rows_stay_whole(spark, docs, name):
    f = OPERATORS[name]
    assert f(docs).count() == len(ROWS)
    assert f(spark.createDataFrame([], SCHEMA)).collect() == []
    more = docs.withColumns({c: F.lit("x") for c in CLASH if c != "KEPT"})
    out = f(more)
    assert out.count() == len(ROWS)
    low = [c.lower() for c in out.columns]
    assert len(low) == len(set(low))
    if name != "simhash":
        assert {"key", "fp", "root", "k", "t", "h", "lang"} <= set(low)
        upper = docs.withColumn("KEPT", F.lit("x"))
        assert f(upper).count() == len(ROWS)


def test_bpe_values(docs):
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    for r in bpe.code(docs, PATH).collect():
        want = t.encode(r.text or "", add_special_tokens=False).ids
        assert r.ids == want and r.decoded == t.decode(want, skip_special_tokens=False)


def test_quality_without_labels(spark, docs, labels):
    weights = quality.train(docs, labels)
    assert weights.shape == (1 << quality.BITS,) and np.isfinite(weights).all()
    none = quality.train(docs, labels.where("false"))
    assert not none.any() and {r.score for r in quality.score(docs, none).collect()} == {0.5}
    assert not quality.score(docs, none).where("doc_id IS NULL AND held_out").count()


def test_exact_values(docs):
    out = exact_dedup.exact_groups(docs).collect()
    hello = [r for r in out if r.text and "Hello" in r.text]
    # The longest original stays, though its key is larger.
    assert {r.keep_id for r in hello} == {2} and {r.group_size for r in hello} == {4} and [r.doc_id for r in hello if r.kept] == [2]
    empty = [r for r in out if not (r.text or "").strip()]
    assert {r.keep_id for r in empty} == {5} and {r.group_size for r in empty} == {4} and {r.text_sha256 for r in empty} == {hashlib.sha256(b"").hexdigest()}
    assert sum(r.kept for r in out) == 4


def test_exact_hot_group(spark):
    """One text has most rows, so that it is salted; results are as without."""
    d = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 != 0, F.concat(F.lit("same"), F.expr("repeat(' ', int(id % 7))"))).otherwise(F.concat(F.lit("own"), F.col("id").cast("string"))).alias("text"))
    assert exact_dedup.hot_texts(d, "text")
    out = exact_dedup.exact_groups(d).collect()
    same = [r for r in out if r.text.startswith("same")]
    best = min((-(r.doc_id % 7), r.doc_id) for r in same)[1]
    assert {r.keep_id for r in same} == {best} and {r.group_size for r in same} == {3000} and [r.doc_id for r in same if r.kept] == [best]
    assert all(r.kept and r.group_size == 1 and r.keep_id == r.doc_id for r in out if not r.text.startswith("same")) and len(out) == 4000


def test_simhash_values(spark, docs):
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.near_groups(docs).collect()}
    zero = {k: c for k, c in got.items() if k[1] == "0" * 16}
    assert {k[0] for k in zero} == {None, 3, 4, 5} and set(zero.values()) == {3}
    kept = simhash.near_representatives(docs).collect()
    assert sorted(r.doc_id for r in kept) == [1, 3, 6, 7]


def test_simhash_chain_of_links(spark):
    """Fingerprints a few bits apart each: the chain's ends differ widely, and are one component."""
    chain, value, rng = [], 0, random.Random(5)
    for k in range(60):
        chain.append((k, value - (1 << 64) if value >> 63 else value))
        for b in rng.sample(range(64), 4):
            value ^= 1 << b
    far = [(1000 + k, int(x)) for k, x in enumerate(np.random.default_rng(1).integers(-(1 << 62), 1 << 62, 40))]
    rows = spark.createDataFrame(chain + far, "key long, fp long")
    got = {r.key: r.component_id for r in simhash.grouped(rows, 4).collect()}
    fps = dict(chain + far)
    root = {k: k for k in fps}
    for _ in range(70):
        for a in fps:
            for b in fps:
                if ((fps[a] ^ fps[b]) & (1 << 64) - 1).bit_count() <= 4:
                    root[a] = root[b] = min(root[a], root[b])
        if root == got:
            break
    assert root == got and len({got[k] for k, _ in chain}) == 1


def test_mixing_meets_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), "hot" if rng.random() < 0.6 else rng.choice(["b", "c", None])) for i in range(3000)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("lang", F.lit("en"))
    out = mixing.mix(d).collect()
    again = mixing.mix(d.repartition(7)).collect()
    assert {r.doc_id: r.taken for r in out} == {r.doc_id: r.taken for r in again}
    by = {}
    for r in out:
        assert r.taken <= 2 * r.size and r.size == len((r.text or "").split())
        x = by.setdefault(r.source, [0, 0, r.target])
        x[0] += r.taken
        x[1] += r.size
    assert sum(t for *_, t in by.values()) == pytest.approx(1.5 * sum(n for _, n, _ in by.values()))
    assert all(abs(taken - target) <= 80 for taken, _, target in by.values())
    assert mixing.mixed(d).count() == sum(r.copies for r in out)


def test_mixing_deals_out_rows_without_a_key(spark):
    """One source and size, 100,000 rows of no key beside 2,000 with one: no cell has more than a few hundred, and the mix is that of a plain numbering."""
    d = spark.range(102_000).select(F.when(F.col("id") >= 100_000, F.col("id")).alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"), F.lit("s").alias("source"))
    plan = mixing.mix(d, weights=(1,), share=0.37)
    out = [(r.doc_id, r.text, r.copies) for r in plan.collect()]
    assert sorted(out, key=repr) == sorted(((r.doc_id, r.text, r.copies) for r in mixing.mix(d.repartition(5), weights=(1,), share=0.37).collect()), key=repr)
    assert len(out) == 102_000 and abs(sum(c for _, _, c in out) - 0.37 * 102_000) <= 1
    # Rows in the order of their hashes: those without a key lie together, between lower and higher ones.
    md5 = lambda k: hashlib.md5(str(k).encode()).hexdigest()
    none = hashlib.md5(b"").hexdigest()
    keyed = sorted((md5(k), c) for k, _, c in out if k is not None)
    low, high = [c for h, c in keyed if h < none], [c for h, c in keyed if h > none]
    offset = int(hashlib.md5(b"42:s").hexdigest()[:8], 16) / 2**32
    crossed = lambda n: math.floor(0.37 * n + offset)
    want = [crossed(n + 1) - crossed(n) for n in range(102_000)]
    assert low == want[: len(low)] and high == want[102_000 - len(high) :]
    hashed = d.select(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("h"), F.when(F.col("doc_id").isNull(), F.xxhash64("text")).alias("u"))
    assert hashed.groupBy(mixing.cell_of("h", "u").alias("cell")).count().agg(F.max("count")).first()[0] < 1000


def test_license_spans(spark):
    mit = license_scan.TEMPLATES[1][1]
    d = spark.createDataFrame([(1, "x " * 9 + mit + " y"), (2, mit.replace("charge,", "charge indeed,")), (3, "granted, free of"), (4, "CC BY-SA cc by"), (5, "cc, by")], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.summary(license_scan.scan(d)).collect()}
    assert got[1].labels == "mit" == got[2].labels and got[1].score == 1 and 0.8 <= got[2].score <= 1
    assert got[3].labels == "" and got[3].score < 0.5
    assert (got[4].n_base, got[4].first_word, got[4].last_word, got[4].base_labels) == (2, 0, 3, "cc-by")
    assert got[5].n_base == 1
    span = license_scan.scan(d).where("doc_id = 1").first().spans[0]
    assert (span["start"], span["end"]) == (9, 9 + len(license_scan.words(mit)))


def test_pii_values(spark):
    good = ["4111 1111 1111 1111", "192.168.0.1", "123-45-6789", "2024-02-29", "jane.doe@mail.example", "+1 (555) 010-1234"]
    bad = ["4111 1111 1111 1112", "192.168.0.256", "000-45-6789", "2023-02-29"]
    d = spark.createDataFrame([(1, " ; ".join(good)), (2, " ; ".join(bad)), (3, " ; ".join(reversed(good))), (4, "no digits here"), (5, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(d, "secret").collect()}
    new = out[1].pseudonymised.split(" ; ")
    shape = lambda s: "".join("0" if c.isdigit() else "a" if c.isalpha() else c for c in s)
    assert all(a != b for a, b in zip(good, new, strict=True))
    assert [shape(a) for i, a in enumerate(good) if i != 1] == [shape(b) for i, b in enumerate(new) if i != 1]
    digits = [int(c) for c in new[0] if c.isdigit()]
    assert sum(sum(divmod(2 * x, 10)) if i % 2 else x for i, x in enumerate(reversed(digits))) % 10 == 0
    assert all(0 <= int(o) <= 255 for o in new[1].split("."))
    assert out[3].pseudonymised.split(" ; ") == new[::-1], "equal values stay linked"
    assert out[2].pseudonymised == " ; ".join(bad) and out[4].pseudonymised == "no digits here" and out[5].pseudonymised is None
    assert pii.pseudonymise(d, "other").where("doc_id = 1").first().pseudonymised != out[1].pseudonymised


def test_pii_permutes(spark):
    """All identity numbers of one area and group of a small format stay apart."""
    d = spark.range(1, 3000).select(F.col("id").alias("doc_id"), F.format_string("123-45-%04d", "id").alias("text"))
    out = [r.pseudonymised for r in pii.pseudonymise(d, "k").collect()]
    assert len(set(out)) == len(out)


def test_warc_ranges_and_rubbish(spark, tmp_path):
    rng = random.Random(4)
    pages = [(i, f"http://h/{i}", "<p>" + "".join(rng.choice("abc\x1f\x8b\x08é") for _ in range(rng.randint(0, 3000)))) for i in range(120)]
    pages += [(200, None, None), (201, "", ""), (202, "http://h/ x\r\n", pages[3][2]), (None, "http://n/", pages[3][2]), (203, "u", None), (2, "http://again/", pages[2][2])]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit("x"))
    files = warc.write_warc(df.repartition(3), f"file://{tmp_path}/w")
    plain = sorted(map(str, (tuple(r) for r in warc.read_warc(files).collect())))
    assert len(plain) == len(pages)
    for span in (1000, 7777):
        assert sorted(map(str, (tuple(r) for r in warc.read_warc(files, span=span).collect()))) == plain
    by = {r.page_id: r for r in warc.read_warc(files).collect()}
    assert by[202].record_type == "revisit" and by[202].refers_to == 3 and by[202].payload is None and by[202].payload_bytes == len(pages[3][2].encode())
    assert by[None].refers_to == 3 and by[200].record_type == "response" and by[201].refers_to == 200 and by[203].refers_to == 200
    assert by[5].payload.decode() == pages[5][2]
    assert warc.read_warc(warc.archives(spark, f"file://{tmp_path}/w")).count() == len(pages)
    assert warc.read_warc(warc.write_warc(df.where("false"), f"file://{tmp_path}/none")).count() == 0
    small = warc.read_warc(warc.write_warc(df, f"file://{tmp_path}/least", least=10_000_000))
    assert {r.record_type for r in small.select("record_type").collect()} == {"response"}
    # Bytes that are no records lie before, between and after: each record has one owner still.
    made = [warc.record(i, "u", b"payload %d" % i, warc.base32_sha1(b"payload %d" % i), None) for i in range(9)]
    dirt = warc.MAGIC + b"\x00\x01junk" + warc.MAGIC * 2
    blob = dirt + dirt.join(made) + dirt
    for span in (50, 333, 10_000):
        found = [x["page_id"] for at in range(0, len(blob), span) for x in warc.records(io.BytesIO(blob), at, at + span)]
        assert found == list(range(9))


def test_chat_values(spark):
    rows = [
        (1, 1, "assistant", "b </turn>\n<turn user>\n"), (1, 0, "user", "a\\<\\\\<é"), (1, 2, None, None), (1, None, "assistant", ""),
        (2, 0, "assistant", "\U0001f600" * 3), (2, 0, "assistant", "\U0001f600" * 3), (None, 0, "r>\n\\g", "x"), (3, 0, "user", LONG), *chat.HOSTILE,
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({c: F.lit("x") for c in ("segment", "loss_start", "LOSS_END")})
    formatted = chat.format_turns(df)
    for r in formatted.collect():
        assert chat.parse(r.segment) == (r.role or "", r.text or "")
        assert r.segment.count("</turn>\n") - r.segment.count("\\</turn>\n") == 1
        if r.role == "assistant":
            assert chat.unescaped(r.segment.encode()[r.loss_start : r.loss_end].decode()) == r.text
        else:
            assert r.loss_start is None
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {1, 2, 3, None, -7} and got[1].n_turns == 4
    assert got[1].turns_sha256 == sha("assistant\n\n" + "user\na\\<\\\\<é\n" + "assistant\nb </turn>\n<turn user>\n\n" + "\n\n")
    assert (got[2].loss_chars, got[2].loss_sha256) == (6, sha("\U0001f600" * 6))
    assert got[-7].loss_sha256 == sha("\\### Assistant: </turn> ok") and got[3].loss_sha256 == sha("")
    assert chat.read_back(chat.format_turns(df.where("false"))).collect() == []


def test_ann_values(spark):
    rng = np.random.default_rng(6)
    some = [(i, rng.standard_normal(4).tolist()) for i in range(1, 40)]
    odd = [(50, None), (100, [0.0] * 4), (150, [1.0, None, 0.0, 0.0]), (200, [float("nan"), 1.0, 0.0, 0.0]), (250, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4)]
    same = [(k, [1.0, 2.0, 3.0, 4.0]) for k in (300, 301, 302, 303, 304, 305, 306, 350)]
    rows = [*some, *odd, *same, same[0]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    got = {}
    for r in ann.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {300, 350}
    assert [i for i, _ in got[300]] == [301, 302, 303, 304, 305] and [i for i, _ in got[350]] == [300, 301, 302, 303, 304]
    assert all(s == pytest.approx(1) for _, s in got[350])
    few = ann.nearest(df.where("vec_id IN (300, 1, 2)"), F.col("vec_id") % 50 == 0).collect()
    assert len(few) == 2
    assert ann.nearest(df.where("false"), F.col("vec_id") % 50 == 0).collect() == []


@pytest.mark.parametrize("k", range(5))
def test_stages_take_any_rows(spark, docs, labels, tmp_path, k):
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[k]
    more = docs.withColumns({c: F.lit("x") for c in ("kept", "root", "predicted", "ids", "copies")})
    out = stage(spark, more, str(tmp_path))
    ids = sorted((r.doc_id is None, r.doc_id or 0) for r in out.collect())
    texts = {r.doc_id: r.text for r in out.collect()} if k < 4 else {}
    known = lambda *x: [(False, i) for i in x]
    if k == 0:
        scores = quality.score(docs, quality.train(docs, labels)).collect()
        assert ids == sorted((r.doc_id is None, r.doc_id or 0) for r in scores if r.predicted)
    elif k == 1:
        assert ids == known(2, 5, 6, 7) and texts[2].startswith("Hello  there")
    elif k == 2:
        assert ids == known(1, 3, 6, 7)
    elif k == 3:
        # A row is taken twice at most, one without words like any other of its source; words come near the target.
        assert all(ids.count(x) <= 2 * sum((r[0] is None, r[0] or 0) == x for r in ROWS) for x in ids)
        words = sum(len((t or "").split()) for *_, t in ((r.doc_id, r.text) for r in out.collect()))
        assert abs(words - 1.5 * sum(len((r[1] or "").split()) for r in ROWS)) < 60_001
    else:
        assert len(ids) == len(ROWS)
        t = Tokenizer.from_file(PATH)
        t.no_truncation()
        t.no_padding()
        of = {}
        for r in ROWS:
            of.setdefault(r[0], set()).add(tuple(t.encode(r[1] or "", add_special_tokens=False).ids))
        assert all(tuple(r.ids) in of[r.doc_id] and r.n_tokens == len(r.ids) for r in out.collect())
    assert stage(spark, spark.createDataFrame([], SCHEMA), str(tmp_path)).collect() == []
    if k < 4:
        assert out.columns == corpus_pipeline.COLUMNS


def test_shared_folder_is_an_error_on_a_cluster(spark):
    class Elsewhere:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Elsewhere)


def test_labels_of_absent_documents_take_no_place(spark, monkeypatch):
    """A labels table far larger than the documents at hand: all of these are learned from."""
    monkeypatch.setattr(quality, "SAMPLE", 50)
    d = spark.createDataFrame([(i, "good clean words" if i % 2 else "$$$ ||| junk") for i in range(40)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id AS doc_id", "id % 2 AS quality")
    few = quality.train(d, labels)
    assert few.any() and np.array_equal(few, quality.train(d, labels.where("doc_id < 40")))


def test_fit_is_ftrl_proximal():
    """The weights against the published update, written for one coordinate at a time."""
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "bb", "c!", "$$", "é"]) for _ in range(rng.randint(0, 12))) for _ in range(30)]
    ys = [int("a" in t) for t in texts]
    z, n = {}, {}

    def weight(i):
        penalty = 0.0 if i == 0 else quality.L1
        v = z.get(i, 0.0)
        if abs(v) <= penalty:
            return 0.0
        return -(v - np.sign(v) * penalty) / ((quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    rows = [dict(zip(*(v.tolist() for v in quality.features(t)), strict=True)) for t in texts]
    order = np.random.default_rng(7)
    for _ in range(quality.ROUNDS):
        for k in order.permutation(len(rows)).tolist():
            w = {i: weight(i) for i in rows[k]}
            p = 1 / (1 + np.exp(-sum(w[i] * x for i, x in rows[k].items())))
            for i, x in rows[k].items():
                g = (p - ys[k]) * x
                sigma = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA
                z[i], n[i] = z.get(i, 0.0) + g - sigma * w[i], n.get(i, 0.0) + g * g
    got = quality.fit(texts, ys)
    want = np.array([weight(i) for i in range(len(got))], np.float32)
    assert np.allclose(got, want, atol=1e-5) and np.count_nonzero(want) > 5
    # A text's score is one sparse dot product.
    for row in rows:
        x = np.zeros(len(got))
        x[list(row)] = list(row.values())
        assert x @ got == pytest.approx(sum(got[i] * v for i, v in row.items()))


def test_features_are_counts():
    """Unigrams, bigrams and repetitions by a plain count, for texts within and over one block."""
    word = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x7f-\xff]+")
    for text in ("", "a", "a b a a", "é$$$ word|word word", "x y z " * 60_000):
        ws = [crc32(w) for w in word.findall(text.encode())]
        counts = {}
        spread = lambda v: max(quality.REPEATS + 1, (v * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 64 - quality.BITS)
        for w in ws:
            counts[spread(w)] = counts.get(spread(w), 0) + 1
        for a, b in zip(ws, ws[1:], strict=False):
            v = spread(a * 0x9E3779B1 + b & (1 << 64) - 1)
            counts[v] = counts.get(v, 0) + 1
        for k in (1, 2):
            counts[k] = sum(a == b for a, b in zip(ws, ws[k:], strict=False))
        at, x = quality.features(text)
        if not ws:
            assert at.tolist() == [0] and x.tolist() == [1.0]
            continue
        size = sum(np.log1p(c) ** 2 for c in counts.values()) ** 0.5
        got = dict(zip(at.tolist(), x.tolist(), strict=True))
        # The second word after another isn't seen across the cut of a block.
        assert got[0] == 1.0 and set(got) == {0, *counts}
        assert all(got[i] == pytest.approx(np.log1p(c) / size, rel=1e-3) for i, c in counts.items() if c)


def test_quality_features_keep_nothing():
    """Words of the texts that were read take no memory of a worker."""
    texts = [" ".join(f"w{k}x{j}" for j in range(500)) for k in range(40)]
    quality.features("first")
    tracemalloc.start()
    for t in texts:
        quality.features(t)
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert held < 500_000  # 20,000 words remembered with their hashes are over 2 MB
