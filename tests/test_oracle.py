"""Every registered trace query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from tracewright.plans import queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables")


def canonical(rows):
    def one(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return repr(float(f"{v:.9g}"))
        return str(v)

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = [tuple(float(v) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect()]
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    as_float = lambda rows: [tuple(float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in r) for r in rows]
    assert canonical(as_float(got)) == canonical(as_float(want))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, DATA).count() > 0
