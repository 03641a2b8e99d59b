"""Clusters around centroids of whole numbers: Lloyd's rounds, in which a vector looks only where its nearest centroid can be.

Every vector carries its centroid, an upper bound on the distance to it and a
lower one on the distance to any other. When the centroids have moved, the
bounds are widened by how far; a vector whose upper bound is under its lower
one, or under half the way from its centroid to the next, has no work. Any
other measures its own centroid, and then only those in a ball around it
(exponion search): both its nearest centroid and the second lie within twice
the upper bound plus the way to the next centroid. Each centroid has the others
in a list sorted by distance, so the ball is the list's beginning. A centroid
on its rim counts, and a vector with any other in reach of its bound is
searched, so that ties are seen, and go to the smaller number.

A round is one pass over the vectors with their bounds, whose rows are written
for the next, and one sum over those that changed their centroid: what they add
to the new and take from the old. Centroids are exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.durable import release
from tracewright.llm.common import durable

#: A component that is larger than this, once multiplied, has no distances that fit a long.
LIMIT = 1 << 26
#: By this share bounds are widened whenever they are computed, for they are rounded.
SLACK = 1e-9
#: Rows that are measured at once.
ROWS = 8192
STATE = "id long, v array<int>, was int, at int, upper double, lower double"


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centroids, exact."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(c).max(initial=0)))
    if 4 * top * top * x.shape[1] < 1 << 53:  # all sums are whole doubles
        x, c = x.astype(np.float64), c.astype(np.float64)
    d = (x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)
    return d.astype(np.int64)


class Moved:
    """A round's centroids: how far each has moved from the last ones, and where its neighbours are."""

    def __init__(self, centres: np.ndarray, before: np.ndarray | None):
        self.centres, self.first = centres, before is None
        k = len(centres)
        between = np.sqrt(distances(centres, centres).astype(np.float64))
        np.fill_diagonal(between, np.inf)
        self.order = np.argsort(between, axis=1, kind="stable")[:, : k - 1]
        self.way = np.take_along_axis(between, self.order, axis=1)  # sorted
        self.next = self.way[:, 0] if k > 1 else np.full(k, np.inf)
        step = np.zeros(k) if before is None else np.sqrt(((centres - before) ** 2).sum(axis=1).astype(np.float64)) * (1 + SLACK)
        self.step = step
        ranked = np.sort(step)
        # The farthest step of all others than a centroid.
        self.others = np.where(step == ranked[-1], ranked[-2] if k > 1 else 0.0, ranked[-1])
        if k > 1 and (step == ranked[-1]).sum() > 1:
            self.others[:] = ranked[-1]

    def look(self, x: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(centroid, distance, distance of the second) of each row among cols, which rise: the first of equals is the smallest."""
        d = distances(x, self.centres[cols])
        best = d.argmin(axis=1)
        rows = np.arange(len(x))
        near = d[rows, best]
        second = np.full(len(x), np.inf)
        if len(cols) > 1:
            second = np.sqrt(np.partition(d, 1, axis=1)[:, 1].astype(np.float64))
        return cols[best], np.sqrt(near.astype(np.float64)) * (1 + SLACK), second * (1 - SLACK)

    def assign(self, x: np.ndarray, at: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """at, upper and lower of every row under these centroids, from those under the last."""
        if self.first:
            return self.look(x, np.arange(len(self.centres)))
        at, upper, lower = at.copy(), upper + self.step[at], lower - self.others[at]
        held = lambda rows: upper[rows] < np.maximum(lower[rows], self.next[at[rows]] / 2 * (1 - SLACK))
        open_ = np.flatnonzero(~held(np.arange(len(x))))
        own = ((x[open_] - self.centres[at[open_]]) ** 2).sum(axis=1)
        upper[open_] = np.sqrt(own.astype(np.float64)) * (1 + SLACK)
        open_ = open_[~held(open_)]
        for a in np.unique(at[open_]).tolist():
            rows = open_[at[open_] == a]
            reach = (2 * upper[rows] + self.next[a]) * (1 + SLACK)
            count = np.searchsorted(self.way[a], reach, side="right")  # those on the rim too
            for m in np.unique(count).tolist():
                some = rows[count == m]
                at[some], upper[some], lower[some] = self.look(x[some], np.sort(np.append(self.order[a, :m], a)))
        return at, upper, lower


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal lengths."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.int64)


def passed(state: DataFrame, moved: Moved) -> DataFrame:
    """Every vector with its new centroid and bounds; was is the centroid that it had, -1 at first."""
    sent = state.sparkSession.sparkContext.broadcast(moved)  # k centroids, and k * k distances

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for whole in batches:
            for i in range(0, whole.num_rows, ROWS):
                b = whole.slice(i, ROWS)
                was = b.column(3).to_numpy(zero_copy_only=False)
                at, upper, lower = m.assign(matrix(b.column(1)), was, b.column(4).to_numpy(), b.column(5).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(was, pa.int32()), pa.array(at, pa.int32()), pa.array(upper), pa.array(lower)], ["id", "v", "was", "at", "upper", "lower"])

    return state.mapInArrow(run, STATE)


def changes(state: DataFrame, size: int) -> dict[int, list[int]]:
    """What each centroid gains by the vectors that changed: their number and the sums of their components, as exact whole numbers."""
    moved = state.where("at <> was")
    signed = moved.select("v", F.explode(F.array(F.struct(F.col("at").alias("k"), F.lit(1).alias("sign")), F.struct(F.col("was").alias("k"), F.lit(-1).alias("sign")))).alias("s")).where("s.k >= 0")
    # Sums of a task's rows are longs: LIMIT times 2 ** 36 rows fit. Their sums are decimals.
    parts = signed.select("s.k", F.spark_partition_id().alias("p"), F.col("s.sign").cast("long").alias("n"), *[(F.col("v")[i].cast("long") * F.col("s.sign")).alias(f"c{i}") for i in range(size)])
    names = ["n", *[f"c{i}" for i in range(size)]]
    local = parts.groupBy("k", "p").agg(*[F.sum(c).alias(c) for c in names])
    found = local.groupBy("k").agg(*[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in names]).collect()  # a row for each centroid
    return {r["k"]: [int(r[c]) for c in names] for r in found}


def cluster(vectors: DataFrame, *, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, seed: int = 1, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) for every vector of `size` components, none null or not finite.

    A component x counts as floor(scale * x). Centroids start as the k vectors
    with the smallest sha256 of "seed:key" (all, if fewer; of rows that share a
    key, those with the smaller components first; null keys last), are replaced
    `rounds` times by the floored means of their vectors, and stay where they
    have none. distance is squared; inertia is its sum, over the cluster and
    over all. Repeated rows are vectors of their own; of equal centroids the
    first has all vectors. A vector whose counted components are beyond LIMIT
    has no distance that fits a long: it is returned with its key alone, and
    counts for nothing. An empty table, or one without such vectors, gives an
    empty one. Other columns are not returned.
    """
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = vectors.where(F.coalesce((F.size(v) == size) & finite, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: x.cast("double") * F.lit(float(scale))).alias("x"))
    fits = F.forall("x", lambda x: F.abs(x) <= float(LIMIT - 1))
    spark = vectors.sparkSession
    state = durable(whole.where(fits).select("id", F.transform("x", lambda x: F.floor(x).cast("int")).alias("v"), F.lit(-1).alias("was"), F.lit(-1).alias("at"), F.lit(0.0).alias("upper"), F.lit(0.0).alias("lower")))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    starts = state.select(digest.alias("h"), "v").orderBy(F.col("h").asc_nulls_last(), "v").limit(k).collect()
    null = F.lit(None)
    far = whole.where(~fits).select(F.col("id").alias(key), null.cast("int").alias("cluster"), *[null.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], null.cast("string").alias("centroid_sha256"))
    if not starts:
        return far
    centres, before = np.array([r["v"] for r in starts], np.int64), None
    totals = [[0] * (size + 1) for _ in starts]
    for turn in range(rounds + 1):
        new = durable(passed(state, Moved(centres, before)))
        release(state)
        state = new
        if turn < rounds:
            for c, gained in changes(state, size).items():
                totals[c] = [a + b for a, b in zip(totals[c], gained, strict=True)]
            before = centres
            centres = np.array([[s // t[0] for s in t[1:]] if t[0] else old.tolist() for t, old in zip(totals, before, strict=True)], np.int64)
    last = F.array(*[F.array(*[F.lit(int(x)) for x in c]) for c in centres])
    square = lambda a, b: (a - b).cast("long") * (a - b).cast("long")
    away = F.aggregate(F.zip_with("v", F.get(last, F.col("at")), square), F.lit(0).cast("long"), lambda s, x: s + x)
    measured = state.select(F.col("id").alias(key), F.col("at").alias("cluster"), away.alias("distance"))
    sums = {r["cluster"]: int(r["s"]) for r in measured.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()}  # a row for each centroid
    long = lambda x: x if abs(x) < 1 << 63 else None
    about = [(c, long(s), long(sum(sums.values())), hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sums.items()]
    named = F.broadcast(spark.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"))
    return measured.join(named, "cluster").select(key, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").unionByName(far)


def oracle(k: int = 16, rounds: int = 3) -> str:
    """The registered query in SQL: every vector meets every centroid in every round."""
    square = "list_sum(list_transform(list_zip({a}, {b}), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256(concat('1:', vec_id))) - 1 AS k, v AS c FROM kept QUALIFY k < {k}
)"""
    ]
    for i in range(rounds + 1):
        parts.append(f"a{i} AS (SELECT vec_id, any_value(v) AS v, min({{'d': {square.format(a='v', b='c')}, 'k': k}}) AS best FROM kept, c{i} GROUP BY vec_id)")
        if i < rounds:
            parts.append(f"""s{i} AS (
  SELECT k, list(m ORDER BY place) AS c FROM (
    SELECT best.k AS k, place, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT best, unnest(v) AS x, unnest(range(64)) AS place FROM a{i}) GROUP BY best.k, place) GROUP BY k
), c{i + 1} AS (SELECT k, list_transform(coalesce(s{i}.c, c{i}.c), lambda x: x::BIGINT) AS c FROM c{i} LEFT JOIN s{i} USING (k))""")
    return f"""
WITH {", ".join(parts)}
SELECT vec_id, best.k::INTEGER AS cluster, best.d::BIGINT AS distance,
       (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia, (sum(best.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.k = best.k
"""


ORACLE = oracle()
