"""Pseudonyms against a version of their own: Python integers, its own calendar of written dates, no Spark."""

import calendar
import datetime
import hashlib
import itertools
import os

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tracewright.llm import pii, queries

DATA = "/root/testdata/sf0.001"


def rounds(a, b, sizes, key, kind, back=False):
    for i in reversed(range(10)) if back else range(10):
        other = b if i % 2 == 0 else a
        f = int(hashlib.sha256(f"{key}|{kind}|{i}|{sizes[0]};{sizes[1]};{other}".encode()).hexdigest()[:15], 16)
        f = -f if back else f
        if i % 2 == 0:
            a = (a + f) % sizes[0]
        else:
            b = (b + f) % sizes[1]
    return a, b


def digits(s, key, kind):
    left = len(s) // 2
    a, b = rounds(int(s[:left]), int(s[left:]), (10**left, 10 ** (len(s) - left)), key, kind)
    return f"{a:0{left}d}{b:0{len(s) - left}d}"


def fill(form, ds):
    it = iter(ds)
    return "".join(next(it) if c in "0123456789" else c for c in form)


def luhn(ds):
    return sum(d if i % 2 == 0 else 2 * d - 9 * (d > 4) for i, d in enumerate(map(int, reversed(ds)))) % 10


#: For fields of these widths: every (year, month, day) that can be so written, in order of time.
DAYS = [(y, m, d) for y in range(1800, 2200) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1)]
SETS = {
    "all": (DAYS, (189, 773)),
    "swapped": ([x for x in DAYS if x[2] > 12], (9, 9833)),
    "11": ([x for x in DAYS if x[1] < 10 and x[2] < 10], (180, 180)),
    "12": ([x for x in DAYS if x[2] < 10], (180, 240)),
    "12 swapped": ([x for x in DAYS if x[1] < 10 and x[2] > 12], (157, 421)),
    "21": ([x for x in DAYS if x[1] < 10], (259, 422)),
}
PLACE = {k: {x: i for i, x in enumerate(days)} for k, (days, _) in SETS.items()}


def exists(y, m, d):
    try:
        datetime.date(y, m, d)
    except ValueError:
        return False
    return True


def date(m, key):
    a, b, c = regex.split("[/.-]", m)
    iso = "-" in m
    tried = [(int(a), int(b), int(c), False)] if iso else [(int(c), int(b), int(a), False), (int(c), int(a), int(b), True)]
    found = [x for x in tried if exists(*x[:3])]
    if not found or not 1800 <= found[0][0] < 2200:
        return None
    y, mo, d, swapped = found[0]
    widths = "22" if iso else f"{len(a)}{len(b)}"
    name = ("swapped" if swapped else "all") if widths == "22" else widths + " swapped" * swapped
    days, sizes = SETS[name]
    at = PLACE[name][y, mo, d]
    while True:
        p, q = rounds(*divmod(at, sizes[1]), sizes, key, "date")
        at = p * sizes[1] + q
        if at < len(days):
            break
    y, mo, d = days[at]
    if iso:
        return f"{y}-{mo:02d}-{d:02d}"
    first, second = (mo, d) if swapped else (d, mo)
    mark = regex.search("[^0-9]", m)[0]
    return f"{first:0{len(a)}d}{mark}{second:0{len(b)}d}{mark}{y}"


def email(m, key):
    local, at, host = m.partition("@")
    shape = regex.sub("[0-9]", "0", regex.sub("[A-Z]", "A", regex.sub("[a-z]", "a", local)))
    a, b = local[: len(local) // 2], local[len(local) // 2 :]

    def shifted(half, other, i):
        stream = hashlib.sha256(f"{key}|email|{i}|{shape};{other}".encode()).hexdigest()
        out = ""
        for p, c in enumerate(half):
            k = int(stream[2 * p : 2 * p + 2] or "0", 16)
            first, n = ("a", 26) if "a" <= c <= "z" else ("A", 26) if "A" <= c <= "Z" else ("0", 10) if "0" <= c <= "9" else (c, 1)
            out += chr((ord(c) - ord(first) + k) % n + ord(first))
        return out

    for i in range(10):
        if i % 2 == 0:
            a = shifted(a, b, i)
        else:
            b = shifted(b, a, i)
    return a + b + at + host


def brute(m, key):
    """(kind, pseudonym) of a candidate, or None."""
    if "@" in m:
        return "email", email(m, key)
    if regex.fullmatch(pii.DATE, m):
        new = date(m, key)
        return new and ("date", new)
    if regex.fullmatch(pii.IP, m):
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        parts = m.split(".")
        if any(p != str(int(p)) for p in parts):
            sets = [[f"{v:0{len(p)}d}" for v in range(256) if len(f"{v:0{len(p)}d}") == len(p) and (f"{v:0{len(p)}d}" != str(v)) == (p != str(int(p)))] for p in parts]
            x, n = [s.index(p) for s, p in zip(sets, parts, strict=True)], [len(s) for s in sets]
            a, b = rounds(x[0] * n[1] + x[1], x[2] * n[3] + x[3], (n[0] * n[1], n[2] * n[3]), key, "padded ip")
            return "ip", ".".join(s[v] for s, v in zip(sets, (a // n[1], a % n[1], b // n[3], b % n[3]), strict=True))
        a, b = rounds(o[0] * 256 + o[1], o[2] * 256 + o[3], (65536, 65536), key, "ip")
        return "ip", f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if regex.fullmatch(pii.SSN, m):
        area, group, serial = map(int, m.split("-"))
        if not 1 <= area <= 899 or area == 666 or not group or not serial:
            return None
        a, b = rounds(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, (898, 99 * 9999), key, "ssn")
        return "ssn", f"{a + 1 + (a >= 665):03d}-{b // 9999 + 1:02d}-{b % 9999 + 1:04d}"
    if regex.fullmatch(pii.PHONE, m):
        country = (regex.match(r"\+[0-9]{1,3}(?![0-9])", m) or [""])[0]
        rest = m[len(country) :]
        return "phone", country + fill(rest, digits(regex.sub("[^0-9]", "", rest), key, "phone"))
    ds = regex.sub("[^0-9]", "", m)
    if luhn(ds):
        return None
    body = digits(ds[:-1], key, "card")
    return "card", fill(m, body + str(-luhn(body + "0") % 10))


def brute_text(text, key):
    counts = dict.fromkeys(pii.KINDS, 0)

    def one(m):
        got = brute(m[0], key)
        if not got:
            return m[0]
        counts[got[0]] += 1
        return got[1]

    return regex.sub(pii.ANY, one, text), counts


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")
def test_whole_texts_are_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    got = {r.doc_id: r for r in queries.op7_pii(spark, DATA).collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        text, counts = brute_text(r.text or "", queries.PII_KEY)
        assert (got[r.doc_id].text or "") == text and {k: got[r.doc_id][f"n_{k}"] for k in pii.KINDS} == counts
    back = pii.restore(pii.pseudonymise(docs, "k"), "k")
    assert back.where("NOT restored <=> text").count() == 0


def written_dates():
    """Every way to write each day of 40 years: both orders, with and without zeros, two marks, year first."""
    out = set()
    for y, m, d in DAYS:
        if not 1980 <= y < 2020:
            continue
        out.add(f"{y}-{m:02d}-{d:02d}")
        for a, b in ((d, m), (m, d)):
            for x, z in itertools.product({f"{a}", f"{a:02d}"}, {f"{b}", f"{b:02d}"}):
                out |= {f"{x}/{z}/{y}"} | ({f"{x}.{z}.{y}"} if y % 8 == 0 else set())
    return sorted(out)


def test_dates_never_meet(spark):
    """No two strings share a pseudonym, each keeps its format, and the key's holder gets all back."""
    df = spark.createDataFrame([(s,) for s in written_dates()], "text string").repartition(16)
    out = pii.pseudonymise(df, "k").select("text", "pseudonymised", "n_date").collect()
    new = {r.text: r.pseudonymised for r in out}
    assert len(new) > 60_000 and len(set(new.values())) == len(new) and all(r.n_date == 1 for r in out)
    some = spark.createDataFrame([(t, new[t]) for t in new if t[-1] in "05" or t[:4] == "1985"], "text string, pseudonymised string").repartition(16)
    assert pii.restore(some, "k").where("restored <> text").count() == 0
    shape = lambda s: regex.sub("[0-9]", "0", s)
    assert all(shape(a) == shape(b) for a, b in new.items())
    for text in itertools.islice(new, 0, None, 97):
        assert new[text] == date(text, "k")


def test_ends_of_the_calendar(spark):
    texts = [x for y in (1800, 1900, 2000, 2199) for x in (f"{y}-01-01", f"{y}-12-31", f"{y}-02-28", f"29/02/{y}", f"02/29/{y}", f"1/31/{y}", f"9/30/{y}", f"31/1/{y}", f"30/9/{y}", f"12/31/{y}", f"1/13/{y}", f"9.9.{y}", f"31/2/{y}", f"2/30/{y}", f"13/13/{y}")] + ["1799-12-31", "2200-01-01", "31/12/1799", "1/1/2200", "0000-01-01"]
    rows = pii.restore(pii.pseudonymise(spark.createDataFrame([(t,) for t in texts], "text string"), "k"), "k").collect()
    assert all(r.pseudonymised == (date(r.text, "k") or r.text) and r.restored == r.text for r in rows)
    # A set of a prime size: what lands on the number beyond it goes on to where that leads.
    days, sizes = SETS["21"]
    beyond = rounds(*divmod(len(days), sizes[1]), sizes, "k", "date", back=True)
    y, m, d = days[beyond[0] * sizes[1] + beyond[1]]
    text = f"{d:02d}/{m}/{y}"
    got = pii.restore(pii.pseudonymise(spark.createDataFrame([(text,)], "text string"), "k"), "k").first()
    assert got.pseudonymised == date(text, "k") and got.restored == text


def test_every_kind_comes_back(spark):
    texts = ["4111 1111 1111 1111 4111111111111111 3782 822463 10005", "192.168.0.1 0.0.0.0 255.255.255.255 256.1.1.1", "192.168.001.001 192.168.1.01 00.0.0.0 000.000.000.000 099.10.9.255 010.256.1.1 1.2.3.040", "123-45-6789 899-99-9999 001-01-0001 665-01-0001 667-01-0001 666-01-0001", "jane.Doe_99@mail.example a@b.c Z9%+-@x.org", "+1 (555) 010-1234 (555) 010-1234 555.010.1234 +44 20 123 4567", "x" * 65 + "@long.example", None, "", "12/31/1999, 31.12.1999; 1/2/2003"]
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id int, text string, restored string, n_ip string")
    out = pii.restore(pii.pseudonymise(df, "k"), "k").orderBy("doc_id").collect()
    assert [r.restored for r in out] == texts and out[6].pseudonymised == texts[6]
    for r in out:
        if r.text is not None:
            text, counts = brute_text(r.text, "k")
            assert r.pseudonymised == text and all(r[f"n_{k}"] == n for k, n in counts.items())
    assert pii.restore(df.where(F.lit(False)), "k", text="text").collect() == []


def test_addresses_never_meet(spark):
    """Over a random set of written forms: no two share a pseudonym, leading zeros stay where they are, and all come back."""
    rng = np.random.default_rng(6)
    forms = lambda v: rng.choice([str(v), f"{v:02d}", f"{v:03d}"], p=[0.6, 0.2, 0.2])
    texts = sorted({".".join(forms(int(v)) for v in row) for row in rng.choice([0, 1, 5, 10, 64, 99, 100, 168, 192, 255], (20_000, 4))})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(8)
    rows = pii.restore(pii.pseudonymise(df, "k"), "k").collect()
    assert len(rows) == len(texts) > 15_000 and all(r.restored == r.text and r.n_ip == 1 for r in rows)
    assert len({r.pseudonymised for r in rows}) == len(rows)
    led = lambda t: [len(p) if p != str(int(p)) else 0 for p in t.split(".")]
    assert all(led(r.text) == led(r.pseudonymised) for r in rows)
    assert all(brute(r.text, "k") == ("ip", r.pseudonymised) for r in rows[::50])
