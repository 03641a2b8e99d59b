"""Formulas with brackets against a reader of their own."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewright.functions import chem


def plain(s):
    """Counts by rewriting innermost brackets until none is left; None if that fails."""
    if re.search(r"[^A-Za-z0-9()]", s):
        return None
    while "(" in s or ")" in s:
        m = re.search(r"\(([^()]*)\)([0-9]*)", s)
        if not m:
            return None
        s = s[: m.start()] + (m[1] and re.sub(r"([A-Z][a-z]?)([0-9]*)", lambda a: f"{a[1]}{int(a[2] or 1) * int(m[2] or 1)}.", m[1]).replace(".", "_")) + s[m.end() :]
        s = s.replace("_", "")
    if re.sub(r"[A-Z][a-z]?[0-9]*", "", s):
        return None
    out = {}
    for e, n in re.findall(r"([A-Z][a-z]?)([0-9]*)", s):
        out[e] = out.get(e, 0) + int(n or 1)
    return out


def test_brackets(spark):
    rng = random.Random(4)

    def made(depth):
        parts = []
        for _ in range(rng.randint(1, 3)):
            n = rng.choice(["", "2", "3", "12"])
            parts.append(f"({made(depth - 1)}){n}" if depth and rng.random() < 0.4 else rng.choice(["H", "O", "Ca", "Si", "C", "Cl"]) + n)
        return "".join(parts)

    texts = sorted({made(3) for _ in range(300)}) + ["Ca(CO3)2", "B(OH)4", "Al2(SO4)3", "CO2", "Mg3(Si(O)2(OH)3)2"]
    got = {r.f: r.d for r in spark.createDataFrame([(t,) for t in texts], "f string").select("f", chem.decomposed(F.col("f")).alias("d")).collect()}
    assert got == {t: plain(t) for t in texts} and any("((" in t or re.search(r"\([^)]*\(", t) for t in texts)
    mass = spark.range(1).select(chem.molar_mass(F.lit("Ca(CO3)2")).alias("m")).first().m
    assert mass == pytest.approx(40.078 + 2 * (12.011 + 3 * 15.999))


@pytest.mark.parametrize("text", ["Ca(CO3", "CaCO3)2", ")(", "Ca-CO3", "ca", "(2)3", "Ca CO3", None])
def test_what_cannot_be_read_is_null(spark, text):
    df = spark.createDataFrame([(text,)], "f string")
    assert tuple(df.select(chem.decomposed(F.col("f")), chem.molar_mass(F.col("f"))).first()) == (None, None)
