"""The licence scan against comparison of all word pairs."""

import os
import random
import re

import numpy as np
import pytest

from tracewright.llm import license_scan, queries


def brute_runs(text, template):
    """Every run that text and template share and that can't be longer, found on the diagonals of all pairs of words."""
    least, out = min(license_scan.LONG, len(template)), []
    for shift in range(-len(template), len(text)):
        n = 0
        for j in range(len(template) + 1):
            i = j + shift
            if 0 <= i < len(text) and j < len(template) and text[i] == template[j]:
                n += 1
                continue
            if n >= least:
                out.append((i - n, j - n, n))
            n = 0
    return sorted(out)


def brute_best(runs):
    """Most words that a chain covers, where it begins and ends: every chain is tried."""
    best = []

    def grow(first, last, covered):
        best.append((-covered, first, last[0] + last[2]))
        for x in runs:
            shared = max(0, last[0] + last[2] - x[0], last[1] + last[2] - x[1])
            ends = last[0] + last[2] < x[0] + x[2] and last[1] + last[2] < x[1] + x[2]
            if x[0] > last[0] and x[1] > last[1] and ends and shared < x[2] and x[0] - last[0] - last[2] <= license_scan.GAP:
                grow(first, x, covered + x[2] - shared)

    for x in runs:
        grow(x[0], x, x[2])
    return min(best)


def words(s):
    return [w.encode() for w in s.split()]


def spans_of(templates, text):
    a = license_scan.Automaton(tuple(templates), ())
    return a.scan(words(text))[1]


@pytest.mark.parametrize("seed", range(150))
def test_spans_are_brute_force(seed):
    """Few different words, so that runs repeat and nest; templates within templates."""
    rng = random.Random(seed)
    base = [rng.choice("abcdefg"[: rng.randint(2, 7)]) for _ in range(30)]
    templates = [("whole", " ".join(base)), ("part", " ".join(base[4:12])), ("head", " ".join(base[:5])), ("two", " ".join(base[6:8])), ("other", " ".join(rng.choice("abcdxyz") for _ in range(10)))]
    pieces = []
    for _ in range(rng.randint(1, 3)):
        a = rng.randrange(25)
        pieces += base[a : a + rng.randint(2, 14)] + [rng.choice(["Q", "a", "b"])] * rng.choice([0, 1, 2, license_scan.GAP, license_scan.GAP + 1])
    text = " ".join(pieces)
    got = spans_of(templates, text)
    for label, t in templates:
        runs = brute_runs(words(text), words(t))
        own = [s for s in got if s["label"] == label]
        if len(runs) > 14:
            continue  # every chain is tried
        if not runs:
            assert not own
            continue
        n = len(t.split())
        assert max(s["covered"] for s in own) == pytest.approx(-brute_best(runs)[0] / n)
        # Spans lie side by side, each the best of the runs that those taken before it leave.
        left = runs
        for s in sorted(own, key=lambda s: -s["covered"]):
            assert s["covered"] == pytest.approx(-brute_best(left)[0] / n)
            left = [r for r in left if r[0] + r[2] <= s["start"] or r[0] >= s["end"]]
        assert not left
        assert all(s["named"] == (s["covered"] >= (1 if n <= license_scan.SHORT else license_scan.COVERED)) for s in own)


def test_runs_of_the_walk(monkeypatch):
    """All runs of all templates come out of one walk."""
    kept = {}
    monkeypatch.setattr(license_scan.Automaton, "spans", lambda self, which, runs: kept.setdefault(which, sorted(runs)) and [])
    for seed in range(60):
        kept.clear()
        rng = random.Random(seed)
        templates = [(str(k), " ".join(rng.choice("abc") for _ in range(rng.randint(1, 12)))) for k in range(4)]
        text = " ".join(rng.choice("abcZ" if seed % 2 else "abc") for _ in range(60))
        license_scan.Automaton(tuple(templates), ()).scan(words(text))
        for k, (_, t) in enumerate(templates):
            assert kept.get(k, []) == brute_runs(words(text), words(t))


def test_embedded_template():
    got = spans_of([("a", "x y z"), ("b", "w x y z v q")], "w x y z v q")
    assert {(s["label"], s["start"], s["end"], s["covered"]) for s in got} == {("a", 1, 4, 1.0), ("b", 0, 6, 1.0)}


def test_stray_run_does_not_close_a_span():
    t = "a b c d e f g h i j k l m n o p q r s t"
    got = spans_of([("t", t)], "a b c d e f g h N d e f N i j k l m n o p q r s t")
    assert max(s["covered"] for s in got) == 1.0


def test_many_copies_in_one_text():
    """Each copy is a span, and ten thousand of them take seconds."""
    t = "licensed under the apache license version 2 0"
    got = spans_of([("apache", t)], " ".join([t] * 10_000))
    assert len(got) == 10_000 and all(s["covered"] == 1 for s in got) and [s["start"] for s in got] == list(range(0, 80_000, 8))


def test_labels_of_public_texts(spark):
    t = dict(enumerate(license_scan.TEMPLATES))
    part = lambda label, k: [x for n, x in t.values() if n == label][k]
    bsd2 = part("bsd", 0) + " " + part("bsd", 1)
    bsd3 = part("bsd", 0) + " " + part("bsd-3-clause", 0) + " " + part("bsd", 1)
    rows = [(1, bsd2, "bsd"), (2, bsd3, "bsd,bsd-3-clause"), (3, part("mit", 3), "mit"), (4, "Licensed under CC BY 4.0", "cc-by,cc-by-4.0"), (5, "Licensed under CC BY", "cc-by"), (6, "Licensed under CC BY-SA 4.0", "cc-by,cc-by-sa"), (7, part("isc", 1), "isc"), (8, part("apache-2.0", 2), "apache-2.0"), (9, part("gpl-notice", 2), "gpl,gpl-notice"), (10, "a licence of nothing", "")]
    df = spark.createDataFrame(rows, "doc_id int, text string, want string")
    got = {r.doc_id: r.labels for r in license_scan.summary(license_scan.scan(df)).collect()}
    assert got == {i: want for i, _, want in rows}


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_labels_and_score_of_whole_tables(spark):
    """labels and score of every document, from all pairs of its words and a template's."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op3_license_scan(spark, DATA).collect()}
    templates = [(label, words_of(t)) for label, t in license_scan.TEMPLATES]
    seen = 0
    for r in docs:
        text, labels, score = np.array(words_of(r.text or "")), set(filter(None, got[r.doc_id].base_labels.split(","))), 0.0
        for label, t in templates:
            least, runs = min(license_scan.LONG, len(t)), []
            # Words that begin a shared run of the least length.
            same = np.ones((max(0, len(text) - least + 1), len(t) - least + 1), bool)
            for k in range(least):
                same &= text[k : len(text) - least + 1 + k, None] == np.array(t[k : len(t) - least + 1 + k])
            starts = {(int(a), int(b)) for a, b in zip(*np.nonzero(same), strict=True)}
            for a, b in starts:
                if (a - 1, b - 1) not in starts:
                    n = 1
                    while (a + n, b + n) in starts:
                        n += 1
                    runs.append((a, b, n + least - 1))
            best = {}
            for x in sorted(runs):
                best[x] = x[2] + max([best[y] - s for y in best if y[0] < x[0] and y[1] < x[1] and y[0] + y[2] < x[0] + x[2] and y[1] + y[2] < x[1] + x[2] and x[0] - y[0] - y[2] <= license_scan.GAP and (s := max(0, y[0] + y[2] - x[0], y[1] + y[2] - x[1])) < x[2]], default=0)
            share = max(best.values(), default=0) / len(t)
            score = max(score, share)
            if share >= (1 if len(t) <= license_scan.SHORT else license_scan.COVERED):
                labels.add(label)
        seen += score > 0.5
        assert got[r.doc_id].labels == ",".join(sorted(labels))
        assert got[r.doc_id].score == pytest.approx(1.0 if got[r.doc_id].n_base else score)
    assert seen


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
