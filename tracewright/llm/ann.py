"""Approximate nearest neighbours by a hierarchical k-means tree.

A tree of centroids is fitted on a bounded sample of unit vectors and sent to
every task. All vectors descend to a leaf. A query goes best bin first: a
priority queue holds open nodes by the cosine to their centroid, leaves come
off it in turn, and the query visits as many as `calibrate` found to reach the
wanted recall on the sample, widening them from one on; it goes on while the
leaves so far hold fewer rows than it wants. Leaves are laid together, or cut,
into shards of a bounded number of vectors, where queries and vectors meet; a
query looks only at the leaves that it visits. A shard that very many queries
visit is dealt out again, as often as their number asks for: all other vectors
are shuffled once. Equal vectors are one class with its smallest ids, so a
vector that most rows share is indexed once, and asked for once.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import durable

#: Vectors that the tree is fitted on at most; children of a node; sample vectors of a leaf, about; rounds of k-means.
SAMPLE, FAN, LEAF, ROUNDS = 16_384, 8, 32, 8
#: Sample vectors that are asked for in calibration, the recall they must reach, and the share of the visits (1 / WIDEN) that a step adds.
ASKED, RECALL, WIDEN = 256, 0.96, 8
#: Classes, and queries, that meet at once on average at most; and salts that ids of a class are ranked in.
BLOCK, ASKS, SALTS = 4096, 16_384, 64


@dataclass
class Tree:
    centres: np.ndarray  # one row for each node; the root is node 0
    children: list[list[int]]
    leaf: list[int]  # number of a leaf, -1 for inner nodes
    n_leaves: int
    visits: int = 1


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; those of the largest and the smallest numbers too, for they are scaled first."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means: unit centres, and the nearest of each row."""
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(ROUNDS):
        at = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        norms = np.linalg.norm(sums, axis=1)
        c = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-30)[:, None], c)
    return c, (x @ c.T).argmax(axis=1)


def fit(x: np.ndarray, seed: int = 7) -> Tree:
    """The tree of unit vectors x, with its visits calibrated on them."""
    rng = np.random.default_rng(seed)
    tree = Tree(np.zeros((1, x.shape[1] if len(x) else 1)), [[]], [-1], 0)
    open_ = [(0, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        parts = []
        if len(rows) > 2 * LEAF:
            c, at = k_means(x[rows], min(FAN, max(2, len(rows) // LEAF)), rng)
            parts = [(c[i], rows[at == i]) for i in np.unique(at).tolist()]
        if len(parts) < 2:  # few rows, or rows that no centre tells apart
            tree.leaf[node] = tree.n_leaves
            tree.n_leaves += 1
            continue
        for centre, own in parts:
            tree.children[node].append(len(tree.leaf))
            open_.append((len(tree.leaf), own))
            tree.centres = np.concatenate([tree.centres, centre[None]])
            tree.children.append([])
            tree.leaf.append(-1)
    calibrate(tree, x)
    return tree


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each unit vector."""
    out = np.zeros(len(x), np.int64)
    open_ = [(0, np.arange(len(x)))]
    while open_:
        node, rows = open_.pop()
        if tree.leaf[node] >= 0:
            out[rows] = tree.leaf[node]
        elif len(rows):
            kids = tree.children[node]
            at = (x[rows] @ tree.centres[kids].T).argmax(axis=1)
            open_ += [(kid, rows[at == i]) for i, kid in enumerate(kids)]
    return out


def leaves(tree: Tree, near: np.ndarray) -> Iterator[int]:
    """Leaves best bin first; near has a query's cosine to every centre."""
    heap = [(0.0, 0)]
    while heap:
        _, node = heapq.heappop(heap)
        if tree.leaf[node] >= 0:
            yield tree.leaf[node]
        for kid in tree.children[node]:
            heapq.heappush(heap, (-near[kid], kid))


def calibrate(tree: Tree, x: np.ndarray, k: int = 5) -> None:
    """Widens the visits until the sample's own queries find RECALL of their k nearest; at the most all leaves are visited."""
    asked = np.arange(0, len(x), max(1, len(x) // ASKED))[:ASKED]
    home = descend(tree, x)
    true = []
    for q in asked.tolist():
        near = x @ x[q]
        near[q] = -2
        true.append(home[np.argsort(-near, kind="stable")[:k]])
    orders = [list(leaves(tree, tree.centres @ x[q])) for q in asked.tolist()]
    tree.visits = 1
    while tree.visits < tree.n_leaves:
        hit = sum(int(np.isin(t, o[: tree.visits]).sum()) for t, o in zip(true, orders, strict=True))
        if hit >= RECALL * sum(map(len, true)):
            break
        tree.visits = min(tree.n_leaves, tree.visits + max(1, tree.visits // WIDEN))


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64) if len(column) else np.zeros((0, 1))


def usable(v: Column) -> Column:
    """No null, no component that is null or not finite, and not all zero."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def smallest_ids(rows: DataFrame, n: int) -> DataFrame:
    """(vector, ids): the n smallest ids of each distinct vector. Ranked in salts first, so that one vector's rows are dealt out."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)))
    own = Window.partitionBy("vector", "salt").orderBy("id")
    few = salted.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= n)
    return few.groupBy("vector").agg(F.slice(F.array_sort(F.collect_list("id")), 1, n).alias("ids"))  # SALTS * n at most


def shards_of(counts: dict[int, int], n_leaves: int) -> list[range]:
    """The shards of each leaf: neighbouring small leaves share one of about BLOCK classes, a large leaf has several of its own."""
    out, shard, held = [], 0, 0
    for leaf in range(n_leaves):
        n = counts.get(leaf, 0)
        if held and held + n > BLOCK:
            shard, held = shard + 1, 0
        parts = max(1, -(-n // BLOCK))
        out.append(range(shard, shard + parts))
        held += n
        if parts > 1:
            shard, held = shard + parts, 0
    return out


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    """In double precision, from sums that are rounded once: it depends on the two vectors alone. Powers of two are taken out first, so that no square is too large or small."""
    a, b = (np.ldexp(v, -int(np.frexp(np.abs(v).max())[1])) for v in (a, b))
    return math.fsum(a * b) / (math.sqrt(math.fsum(a * a)) * math.sqrt(math.fsum(b * b)))


def meet(left: pd.DataFrame, right: pd.DataFrame, k: int) -> Iterator[tuple[int, int, float]]:
    """(q, id, score) of the k best classes that each query of left finds in the leaves it visits of the shard, and all that tie with the last."""
    right = right.sort_values("leaf", kind="stable")
    x, ids, home = matrix(right["vector"]), right["ids"].to_list(), right["leaf"].to_numpy()
    directions = unit(x)
    for at in range(0, len(left), 256):
        some = left.iloc[at : at + 256]
        vectors = matrix(some["query"])
        near = unit(vectors) @ directions.T
        for q, v, leaf, row in zip(some["q"].to_list(), vectors, some["leaves"].to_list(), near, strict=True):
            here = np.flatnonzero(np.isin(home, leaf))
            if not len(here):
                continue
            n = min(k, len(here))
            least = np.partition(row[here], -n)[-n]
            for j in here[row[here] >= least - 1e-9].tolist():
                score = cosine(v, x[j])
                yield from ((q, int(i), score) for i in ids[j])


def nearest(vectors: DataFrame, is_query: Column, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", seed: int = 7) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row that is_query holds for, among all other rows.

    Nearness is the cosine in double precision, ties go to the smaller id.
    Vectors that are null, zero, or have a component null or not finite take no
    part, nor do rows without id. Vectors are compared with those of their own
    length only: each length is a table of its own. Repeated rows are one
    candidate, and one query. A query with k candidates or more has k results,
    others have all. An empty table gives an empty result. Other columns are
    not returned.
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    widths = sorted(r[0] for r in rows.where("asked").select(F.size("vector")).distinct().collect())  # a number for each length
    found = [nearest_of(rows.where(F.size("vector") == w).distinct(), k, seed) for w in widths]
    return reduce(DataFrame.unionByName, found) if found else rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")


def nearest_of(rows: DataFrame, k: int, seed: int) -> DataFrame:
    """nearest for distinct rows (id, vector, asked) of vectors of one length."""
    spark = rows.sparkSession
    classes = durable(smallest_ids(rows.select("id", "vector"), k + 1))
    # The sample: SAMPLE classes at most, by a hash of the vector.
    sample = classes.select("vector").orderBy(F.xxhash64("vector"), "vector").limit(SAMPLE).toPandas()["vector"]
    tree = spark.sparkContext.broadcast(fit(unit(matrix(sample)), seed))  # a centre for each node: under SAMPLE

    @F.pandas_udf("int")
    def leaf_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(descend(tree.value, unit(matrix(x))), dtype="int32")

    index = durable(classes.select("vector", "ids", leaf_of("vector").alias("leaf")))
    counted = index.groupBy("leaf").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("ids")).alias("ids")).collect()  # a row for each leaf
    held = {r["leaf"]: r["ids"] for r in counted}
    shards = shards_of({r["leaf"]: r["n"] for r in counted}, tree.value.n_leaves)
    first, parts = (F.array(*[F.lit(x) for x in of]) for of in ([r.start for r in shards], [len(r) for r in shards]))
    at = F.col("leaf") + 1
    placed = index.withColumn("shard", F.element_at(first, at) + F.pmod(F.xxhash64("vector"), F.element_at(parts, at)).cast("int"))

    @F.pandas_udf("array<struct<shard: int, leaves: array<int>>>")
    def to_visit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        t = tree.value
        for x in batches:
            out = []
            for near in unit(matrix(x)) @ t.centres.T:
                of: dict[int, list[int]] = {}
                met = 0
                for n, leaf in enumerate(leaves(t, near)):
                    if n >= t.visits and met > k:  # k and the query itself
                        break
                    met += held.get(leaf, 0)
                    for s in shards[leaf]:
                        of.setdefault(s, []).append(leaf)
                out.append([{"shard": s, "leaves": v} for s, v in of.items()])
            yield pd.Series(out)

    # Equal queries ask once, under the smallest of their ids.
    asked = rows.where("asked").select("id", "vector")
    queries = durable(asked.groupBy("vector").agg(F.min("id").alias("q")))
    visits = durable(queries.select("q", F.col("vector").alias("query"), F.explode(to_visit("vector")).alias("v")).select("q", "query", "v.shard", "v.leaves"))
    blocks = durable(visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / ASKS).cast("int").alias("blocks")))
    visits = visits.join(blocks, "shard").withColumn("part", F.pmod(F.xxhash64("q"), F.col("blocks")).cast("int")).drop("blocks")
    copies = placed.join(blocks, "shard").select("vector", "ids", "leaf", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("part"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(list(meet(left, right, k + 1)) if len(left) and len(right) else [], columns=["q", "id", "s"])

    found = visits.groupBy("shard", "part").cogroup(copies.groupBy("shard", "part")).applyInPandas(run, "q long, id long, s double")
    best = Window.partitionBy("q").orderBy(F.desc("s"), "id")
    few = found.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k + 1)
    lists = few.groupBy("q").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "id", "s"))), lambda x: F.struct(x["id"].alias("id"), x["s"].alias("s"))).alias("found"))
    # Each row's own id is among the k + 1 or it isn't; k remain.
    own = asked.select(F.col("id").alias("query_id"), "vector").join(queries, "vector").select("query_id", "q").join(lists, "q")
    ranked = own.select("query_id", F.posexplode(F.slice(F.filter("found", lambda x: x["id"] != F.col("query_id")), 1, k)).alias("pos", "x"))
    return ranked.select("query_id", (F.col("pos") + 1).alias("rank"), F.col("x.id").alias("vec_id"), F.col("x.s").alias("score"))
