"""A stream in several batches gives the table's rows, over restarts too."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.streaming import traces

SCHEMA = "sample string, ts timestamp, a double, b double"
ZERO = dt.datetime(2024, 1, 1)
HOW = {"gap": 60.0, "late": "30 seconds", "nlim": 1.0, "maxiter": 3}


def readings(seed=3, n=400):
    rng, out, at = random.Random(seed), [], 0.0
    for _ in range(n):
        at += rng.choice([1, 1, 2, 3, 5, 0, 40 if rng.random() < 0.1 else 1, 200 if rng.random() < 0.15 else 2])
        for s in ("x", "y", "z")[: rng.randint(1, 3)]:
            a = rng.choice([5.0, 5.0, 6.0, 20.0, 21.0, 100.0, None, math.nan])
            out.append((s, ZERO + dt.timedelta(seconds=at, milliseconds=rng.randint(0, 3)), a, rng.choice([1.0, 1.0, 30.0, None])))
    return out


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def write(spark, part, path, schema=SCHEMA):
    spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def run(spark, tmp_path):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def go():
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        out = traces.despiked_traces(stream, ["a", "b"], 10.0, **HOW)
        q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(200)
        assert q.exception() is None and not q.isActive
        return spark.read.parquet(str(tmp_path / "out"))

    yield go, str(tmp_path / "in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def test_batches_and_a_restart_give_the_table_s_rows(spark, run):
    go, path = run
    data = readings()
    # Readings of about 20 seconds come in any order, over the borders of batches too.
    rng = random.Random(1)
    mixed = sorted(data, key=lambda r: r[1] + dt.timedelta(seconds=rng.random() * 20))
    cuts = [0, 150, 160, 400, len(mixed)]
    for lo, hi in list(zip(cuts, cuts[1:]))[:2]:
        write(spark, mixed[lo:hi], path)
    early = go().count()
    for lo, hi in list(zip(cuts, cuts[1:]))[2:]:
        write(spark, mixed[lo:hi], path)
    # A reading long after ends all traces; one that is too late is left out.
    end = max(r[1] for r in data) + dt.timedelta(hours=1)
    write(spark, [("w", end, 1.0, 1.0)], path)
    write(spark, [("x", ZERO, 999.0, 1.0), ("w", end + dt.timedelta(seconds=1), 1.0, 1.0)], path)
    got = go()
    table = spark.createDataFrame(data, SCHEMA)
    want = rows(traces.despiked_traces(table, ["a", "b"], 10.0, **HOW))
    assert 0 < early < len(want) == len(data)
    assert rows(got.where("sample != 'w'")) == want


def test_the_table_s_rows_are_brute_force(spark):
    data = readings(5, 200) + [(None, ZERO, 1.0, 1.0), ("x", None, 1.0, 1.0)]
    got = {(r.sample, r.start, r.idx): (r.ts, r.a, r.run) for r in traces.despiked_traces(spark.createDataFrame(data, SCHEMA), ["a"], 10.0, **HOW).collect()}
    want, key = {}, lambda r: (r[1], r[2] is not None and not math.isnan(r[2]), r[2] or 0.0)
    for s in "xyz":
        own, parts = sorted((r for r in data if r[0] == s and r[1]), key=key), []
        for r in own:
            if not parts or (r[1] - parts[-1][-1][1]).total_seconds() > 60:
                parts.append([])
            parts[-1].append(r)
        for part in parts:
            v = [None if r[2] is None or math.isnan(r[2]) else r[2] for r in part]
            for _ in range(3):
                new = list(v)
                for i in range(1, len(v) - 1):
                    near = [x for x in v[i - 1 : i + 2] if x is not None]
                    if v[i] is not None and (m := sum(near) / len(near)) >= 0 and v[i] > m + math.sqrt(m):
                        new[i] = m
                v = new
            n = 0
            for i, x in enumerate(v):
                on = x is not None and x > 10
                n += on and not (i and v[i - 1] is not None and v[i - 1] > 10)
                want[s, part[0][1], i] = (part[i][1], x, n if on else 0)
    assert got == want and len({k[:2] for k in got}) > 6


def test_an_empty_table_and_other_columns(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert traces.despiked_traces(none, ["a"], 1.0).collect() == []
    one = spark.createDataFrame([("x", ZERO, 3.0, 1.0)], SCHEMA).withColumn("run", F.lit("mine")).withColumn("idx", F.lit(7)).withColumn("start", F.lit(1))
    assert [tuple(r) for r in traces.despiked_traces(one, ["a"], 1.0).collect()] == [("x", ZERO, 0, ZERO, 3.0, 1)]
    with pytest.raises(ValueError):
        traces.despiked_traces(none, [], 1.0)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 7, 50])
def test_pieces_are_the_whole(n):
    rng = np.random.default_rng(n)
    x = rng.choice([1.0, 2.0, 50.0, np.nan], n)
    whole = traces.passes(x, 0, True, 1, 1.0, 3)
    for cut in range(3, n - 3, 5):
        left = traces.passes(x[: cut + 3], 0, cut + 3 == n, 1, 1.0, 3)[:cut]
        right = traces.passes(x[cut - 3 :], cut - 3, True, 1, 1.0, 3)[3:]
        np.testing.assert_array_equal(np.concatenate([left, right]), whole)
