"""Clusters of rows in the space of their values, and principal components.

Labels are ordered by the clusters' mean first value, from 0; -1 is noise, -2
marks rows with a null. The population is clustered by Spark's own k-means and
by mean shift. For each sample by itself there are k-means, mean shift and
DBSCAN: rows are filed in cells as wide as the bandwidth (or eps), counts and
means of cells are aggregates, and only rows of neighbouring cells meet, so
that no task holds a sample and rows never meet all others.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.durable import durable, release

#: Rounds of k-means and mean shift at most; a centre rests when it moves by less than this share of the bandwidth.
ROUNDS, REST = 100, 1e-3
#: The bandwidth is estimated from the distances of rows to all of their sample's: NEAREST is the share of these that lies within it.
NEAREST = 0.3
#: Rows of a sample that ask one by one; about so many cells of more rows do.
CELLS = 1024
#: A cell's side in parts, of which DBSCAN keeps bounding boxes.
PARTS = 4


def _ready(df: DataFrame, values: list[str]) -> DataFrame:
    return df.where(_whole(values))


def _whole(values: list[str]) -> Column:
    return F.greatest(*[(F.col(v).isNull() | F.isnan(F.col(v).cast("double"))).cast("int") for v in values], F.lit(0)) == 0


def _distance2(a: list[Column], b: list[Column]) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


class Classifier:
    """K-means or mean shift fitted on pooled rows and applied to any.

    Rows with a null or NaN are not fitted, and get -2. With normalise, or with
    more than one value, values are in units of their deviations; bandwidth is
    in those units then. Fewer than min_data rows give no cluster: all rows
    get -2.
    """

    def __init__(self, values: list[str], k: int = 2, sort_by: int = 0, seed: int = 7, method: str = "kmeans", bandwidth: float | None = None, normalise: bool = True, min_data: int = 1, asked: int | None = None):
        if method not in ("kmeans", "meanshift"):
            raise ValueError(f"pooled rows are clustered by kmeans or meanshift, not {method!r}")
        self.values, self.k, self.sort_by, self.seed, self.method, self.bandwidth = values, k, sort_by, seed, method, bandwidth
        self.normalise, self.min_data, self.asked = normalise or len(values) > 1, min_data, asked
        self.model: PipelineModel | None = None
        self.order: list[int] = []
        #: Mean and deviation of each value, and the centres in these units.
        self.units: list[tuple[float, float]] = []
        self.centres: list[list[float]] = []

    def fit(self, df: DataFrame) -> Classifier:
        rows = _ready(df, self.values)
        self.model, self.centres, self.order = None, [], []
        if rows.limit(self.min_data).count() < self.min_data:
            return self
        if self.method == "meanshift":
            return self._fit_shift(rows)
        steps = [VectorAssembler(inputCols=self.values, outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=self.normalise, withStd=self.normalise), KMeans(k=self.k, featuresCol="__z", predictionCol="__cluster", seed=self.seed)]
        self.model = Pipeline(stages=steps).fit(rows.select(*self.values))
        centres = [c[self.sort_by] for c in self.model.stages[-1].clusterCenters()]
        self.order = sorted(range(len(centres)), key=centres.__getitem__)
        return self

    def _fit_shift(self, rows: DataFrame) -> Classifier:
        found = rows.agg(*[f(v) for v in self.values for f in (F.avg, F.stddev_pop)]).first()
        self.units = [(found[2 * i] or 0.0, found[2 * i + 1] or 1.0) if self.normalise else (0.0, 1.0) for i in range(len(self.values))]
        z = rows.select(F.lit(0).alias("sample"), F.monotonically_increasing_id().alias("idx"), *[((F.col(v) - m) / s).alias(v) for v, (m, s) in zip(self.values, self.units, strict=True)])
        centres = mean_shift_centres(durable(z), self.values, self.bandwidth, self.asked)
        # A row for each cluster.
        self.centres = sorted(([r[v] for v in self.values] for r in centres.collect()), key=lambda c: c[self.sort_by])
        return self

    def predict(self, df: DataFrame, name: str = "cluster") -> DataFrame:
        if self.method == "meanshift":
            z = [(F.col(v) - m) / s for v, (m, s) in zip(self.values, self.units, strict=True)]
            nearest = F.array_min(F.array(*[F.struct(_distance2(z, [F.lit(x) for x in c]).alias("d"), F.lit(i).alias("i")) for i, c in enumerate(self.centres)]))["i"] if self.centres else F.lit(-2)
            return df.withColumn(name, F.when(_whole(self.values), nearest).otherwise(-2))
        if self.model is None:
            return df.withColumn(name, F.lit(-2))
        rank = F.create_map(*[F.lit(x) for i, c in enumerate(self.order) for x in (c, i)])
        filled = df.withColumns({f"__f_{v}": F.coalesce(F.nanvl(F.col(v).cast("double"), F.lit(None)), F.lit(0.0)) for v in self.values}).withColumn("__ready", _whole(self.values))
        renamed = filled.withColumnsRenamed({v: f"__own_{v}" for v in self.values}).withColumnsRenamed({f"__f_{v}": v for v in self.values})
        out = self.model.transform(renamed).withColumn(name, F.when(F.col("__ready"), rank[F.col("__cluster")]).otherwise(-2))
        return out.drop("__x", "__z", "__cluster", "__ready", *self.values).withColumnsRenamed({f"__own_{v}": v for v in self.values})


# Rows of the functions below are (sample, idx, values ...), without nulls.


def nearest_centre(rows: DataFrame, centres: DataFrame, values: list[str]) -> DataFrame:
    """rows with k, that of the sample's nearest centre (sample, k, values ...); ties to the smaller. A sample has a handful of centres."""
    c = centres.select("sample", "k", *[F.col(v).alias(f"__c_{v}") for v in values]).groupBy("sample").agg(F.collect_list(F.struct("k", *[f"__c_{v}" for v in values])).alias("__c"))
    far = lambda x: F.struct(_distance2([F.col(v) for v in values], [x[f"__c_{v}"] for v in values]).alias("d"), x["k"].alias("k"))
    return rows.join(c, "sample").withColumn("k", F.array_min(F.transform("__c", far))["k"]).drop("__c")


def k_means(rows: DataFrame, values: list[str], k: int = 2) -> DataFrame:
    """rows with k, by rounds of means. Centres start at evenly spaced ranks of the first value."""
    order = Window.partitionBy("sample").orderBy(values[0], *values[1:], "idx")
    n = F.count(F.lit(1)).over(Window.partitionBy("sample"))
    ranked = rows.withColumn("__at", F.row_number().over(order) - 1).withColumn("__n", n)
    start = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    centres = ranked.select("*", start.alias("k")).where(F.col("__at") == F.floor((F.col("k") + 0.5) * F.col("__n") / k)).select("sample", "k", *values)
    centres = last = durable(centres)
    for _ in range(ROUNDS):
        means = nearest_centre(rows, centres, values).groupBy("sample", "k").agg(*[F.avg(v).alias(f"__m_{v}") for v in values])
        # A centre without rows stays.
        new = durable(centres.join(means, ["sample", "k"], "left").select("sample", "k", *[F.coalesce(f"__m_{v}", v).alias(v) for v in values], F.greatest(*[F.abs(F.coalesce(f"__m_{v}", v) - F.col(v)) for v in values], F.lit(0.0)).alias("moved")))
        release(last)
        centres, last = new.drop("moved"), new
        if new.where("moved > 1e-12").isEmpty():
            break
    return nearest_centre(rows, centres, values)


def bandwidths(rows: DataFrame, values: list[str], asked: int | None = None) -> DataFrame:
    """(sample, bw): the mean, over the sample's rows, of the distance within which NEAREST of its rows lie; 1 where that is 0.

    All rows ask. Those of a sample of more than CELLS are counted first: its
    box is cut into about CELLS cells, and the rows of a cell are one at their
    mean that counts for all of them, so that cells meet cells. With `asked`, so
    many rows of each sample ask, by a hash, for distances to all rows.
    """
    if asked is None:
        ends = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("__rows"), *[f(v).alias(f"__{n}_{v}") for v in values for n, f in (("lo", F.min), ("hi", F.max))])
        at = lambda v: F.least(F.floor(F.try_divide((F.col(v) - F.col(f"__lo_{v}")) * _bins(len(values)), F.col(f"__hi_{v}") - F.col(f"__lo_{v}"))), F.lit(_bins(len(values)) - 1))
        own = F.when(F.col("__rows") <= CELLS, F.col("idx"))
        binned = rows.join(ends, "sample").groupBy("sample", own.alias("__own"), *[F.coalesce(at(v), F.lit(0)).alias(f"__b_{v}") for v in values])
        table = durable(binned.agg(F.count(F.lit(1)).alias("__n"), *[F.avg(v).alias(v) for v in values]))
        asks = table
    else:
        few = Window.partitionBy("sample").orderBy(F.xxhash64("idx", *values), "idx")
        table = rows.withColumn("__n", F.lit(1).cast("long"))
        asks = table.withColumn("__nth", F.row_number().over(few)).where(F.col("__nth") <= asked)
    asks = asks.select("sample", F.monotonically_increasing_id().alias("q"), F.col("__n").alias("__times"), *[F.col(v).alias(f"__q_{v}") for v in values])
    d = F.sqrt(_distance2([F.col(v) for v in values], [F.col(f"__q_{v}") for v in values]))
    met = table.join(asks, "sample").groupBy("sample", "q", "__times")
    if asked is None:  # about CELLS distances: the first, in order, that NEAREST of the rows lie within
        wanted = F.ceil(F.lit(NEAREST) * F.col("__of"))
        step = lambda a, x: F.when(a["n"] >= F.col("__k"), a).otherwise(F.struct((a["n"] + x["__n"]).alias("n"), x["d"].alias("d")))
        each = met.agg(F.array_sort(F.collect_list(F.struct(d.alias("d"), "__n"))).alias("__d"), F.sum("__n").alias("__of")).withColumn("__k", wanted)
        each = each.withColumn("d", F.aggregate("__d", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("d")), step)["d"])
    else:
        each = met.agg(F.percentile_approx(d, NEAREST, 10_000).alias("d"))
    bw = each.groupBy("sample").agg((F.sum(F.col("d") * F.col("__times")) / F.sum("__times")).alias("bw"))
    return bw.withColumn("bw", F.when(F.col("bw") > 0, F.col("bw")).otherwise(1.0))


def _bins(n: int) -> int:
    """Parts of each of n values' ranges."""
    return max(2, round(CELLS ** (1 / n)))


def _cells(values: list[str], width: Column) -> list[Column]:
    return [F.floor(F.col(v) / width).alias(f"c{i}") for i, v in enumerate(values)]


def _around(n: int, reach: int) -> list[tuple[int, ...]]:
    """Cells of n dimensions, as wide as 1 / sqrt(n) of a distance, or as the distance where reach is 1, that may hold something within it."""
    near = lambda o: sum(max(abs(x) - 1, 0) ** 2 for x in o) <= (n if reach > 1 else 1)
    return [o for o in itertools.product(range(-reach, reach + 1), repeat=n) if near(o)]


def _beside(df: DataFrame, n: int, reach: int) -> DataFrame:
    """df for each cell around its own."""
    by = F.explode(F.array(*[F.struct(*[F.lit(x).alias(f"o{i}") for i, x in enumerate(o)]) for o in _around(n, reach)]))
    out = df.select("*", by.alias("__o")).withColumns({f"c{i}": F.col(f"c{i}") + F.col(f"__o.o{i}") for i in range(n)})
    return out.drop("__o")


def mean_shift_centres(rows: DataFrame, values: list[str], bandwidth: float | None = None, asked: int | None = None) -> DataFrame:
    """(sample, k, values ...): where means of a flat kernel come to rest that start at every cell's mean; of centres within a bandwidth of each other the one with most rows stays."""
    n, v = len(values), [F.col(x) for x in values]
    cells = [f"c{i}" for i in range(n)]
    bw = bandwidths(rows, values, asked) if bandwidth is None else rows.select("sample").distinct().withColumn("bw", F.lit(float(bandwidth)))
    bw = durable(bw)
    filed = durable(rows.join(bw, "sample").select("sample", "bw", *values, *_cells(values, F.col("bw"))))
    seeds = filed.groupBy("sample", "bw", *cells).agg(*[F.avg(x).alias(f"s_{x}") for x in values]).drop(*cells)
    seeds = durable(seeds.select("sample", "bw", F.row_number().over(Window.partitionBy("sample").orderBy(*[f"s_{x}" for x in values])).alias("seed"), *[f"s_{x}" for x in values]))
    done = []
    for _ in range(ROUNDS):
        at = seeds.select("*", *[F.floor(F.col(f"s_{x}") / F.col("bw")).alias(f"c{i}") for i, x in enumerate(values)])
        met = _beside(at, n, 1).join(filed.drop("bw"), ["sample", *cells]).where(_distance2(v, [F.col(f"s_{x}") for x in values]) <= F.col("bw") * F.col("bw"))
        moved = met.groupBy("sample", "bw", "seed", *[f"s_{x}" for x in values]).agg(F.count(F.lit(1)).alias("n"), *[F.avg(x).alias(f"t_{x}") for x in values])
        step = F.greatest(*[F.abs(F.col(f"t_{x}") - F.col(f"s_{x}")) for x in values], F.lit(0.0))
        new = durable(moved.withColumn("rests", step < REST * F.col("bw")).select("sample", "bw", "seed", "n", "rests", *[F.col(f"t_{x}").alias(f"s_{x}") for x in values]))
        done.append(new.where("rests"))
        seeds = new.where("NOT rests").drop("n", "rests")
        if seeds.isEmpty():
            break
    else:
        done.append(new.where("NOT rests"))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        """The centres of one sample, at most one for each cell that it fills."""
        pdf = pdf.sort_values(["n", *names], ascending=[False, *[True] * n], kind="stable")
        x, kept = pdf[names].to_numpy(float), []
        for p in x:
            if all(((p - c) ** 2).sum() > pdf["bw"].iloc[0] ** 2 for c in kept):
                kept.append(p)
        out = pd.DataFrame(np.stack(kept), columns=values)
        out.insert(0, "k", range(len(out)))
        out.insert(0, "sample", pdf["sample"].iloc[0])
        return out

    names = [f"s_{x}" for x in values]
    key = rows.schema["sample"].dataType.simpleString()
    return durable(found.groupBy("sample").applyInPandas(apart, f"sample {key}, k int, " + ", ".join(f"`{x}` double" for x in values)))


def mean_shift(rows: DataFrame, values: list[str], bandwidth: float | None = None, asked: int | None = None) -> DataFrame:
    return nearest_centre(rows, mean_shift_centres(rows, values, bandwidth, asked), values)


def linked_cells(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, root) for every node: root is the smallest node that it reaches by edges (a, b). Roots pass on by rounds, each at twice the reach."""
    both = durable(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    roots = last = durable(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(roots.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("__r"))
        new = roots.join(near, "node", "left").select("node", F.coalesce(F.least("root", "__r"), "root").alias("new"), F.col("root").alias("old"))
        # The root's own root, as it was.
        up = roots.select(F.col("node").alias("new"), F.col("root").alias("__up"))
        new = durable(new.join(up, "new", "left").select("node", F.least("new", "__up").alias("root"), "old"))
        release(last)
        roots, last = new.select("node", "root"), new
        if new.where("root <> old").isEmpty():
            return roots


def dbscan(rows: DataFrame, values: list[str], eps: float = 0.5, least: int = 5) -> DataFrame:
    """rows with k: the number, from 0, of the density-connected cluster in order of its first core row; null for noise. A border row belongs to the first cluster that it touches.

    Cells have a diagonal of eps, so that all rows of a cell with `least` of
    them are core, and one cluster. Other rows look into the cells around.
    Whether two cells touch is told from bounding boxes of their parts, and
    from rows only where these leave it open.
    """
    n = len(values)
    cells, reach, e2 = [f"c{i}" for i in range(n)], 1 if n == 1 else math.ceil(math.sqrt(n)), F.lit(float(eps) ** 2)
    width = F.lit(float(eps) / math.sqrt(n))
    at = F.struct("sample", *cells)
    filed = durable(rows.select("sample", "idx", *values, *_cells(values, width)))
    counts = durable(filed.groupBy("sample", *cells).agg(F.count(F.lit(1)).alias("__n")))
    sized = durable(filed.join(counts, ["sample", *cells]))
    sparse = sized.where(F.col("__n") < least).select("sample", F.col("idx").alias("__i"), *[F.col(v).alias(f"__q_{v}") for v in values], *cells)
    close = _distance2([F.col(v) for v in values], [F.col(f"__q_{v}") for v in values]) <= e2
    looked = _beside(sparse, n, reach).join(filed, ["sample", *cells]).where(close)
    cores = looked.groupBy("sample", "__i").agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") >= least).select("sample", F.col("__i").alias("idx"))
    core = durable(sized.where(F.col("__n") >= least).drop("__n").unionByName(sized.where(F.col("__n") < least).drop("__n").join(cores, ["sample", "idx"], "left_semi").select("sample", "idx", *values, *cells)))

    part = [F.floor(F.col(v) / (width / PARTS)).alias(f"p{i}") for i, v in enumerate(values)]
    boxes = core.select("*", *part).groupBy("sample", *cells, *[f"p{i}" for i in range(n)]).agg(*[x for v in values for x in (F.min(v).alias(f"lo_{v}"), F.max(v).alias(f"hi_{v}"))])
    boxes = durable(boxes.withColumn("a", at))
    other = boxes.select("sample", *cells, F.col("a").alias("b"), *[F.col(f"p{i}").alias(f"r{i}") for i in range(n)], *[F.col(f"{s}_{v}").alias(f"__{s}_{v}") for v in values for s in ("lo", "hi")])
    pairs = _beside(boxes, n, reach).join(other, ["sample", *cells]).where("a < b")
    gap = lambda v: F.greatest(F.col(f"__lo_{v}") - F.col(f"hi_{v}"), F.col(f"lo_{v}") - F.col(f"__hi_{v}"), F.lit(0.0))
    span = lambda v: F.greatest(F.col(f"__hi_{v}") - F.col(f"lo_{v}"), F.col(f"hi_{v}") - F.col(f"__lo_{v}"))
    least2, most2 = (sum((f(v) * f(v) for v in values), F.lit(0.0)) for f in (gap, span))
    # In one dimension the boxes' ends are rows.
    sure = least2 <= e2 if n == 1 else most2 <= e2
    pairs = durable(pairs.where(least2 <= e2).select("sample", "a", "b", *[f"p{i}" for i in range(n)], *[f"r{i}" for i in range(n)], sure.alias("sure")))
    edges = pairs.where("sure").select("a", "b").distinct()
    if n > 1:
        edges = durable(edges)
        open_ = pairs.where("NOT sure").join(edges, ["a", "b"], "left_anti")
        mine = core.select("sample", at.alias("a"), *part, *values)
        theirs = core.select("sample", at.alias("b"), *[p.alias(f"r{i}") for i, p in enumerate(part)], *[F.col(v).alias(f"__q_{v}") for v in values])
        met = open_.join(mine, ["sample", "a", *[f"p{i}" for i in range(n)]]).join(theirs, ["sample", "b", *[f"r{i}" for i in range(n)]])
        edges = edges.unionByName(met.where(close).select("a", "b").distinct())
    roots = linked_cells(edges, core.select(at.alias("node")).distinct())
    of = durable(core.withColumn("node", at).join(roots, "node").select("sample", "idx", *values, *cells, "root"))
    firsts = of.groupBy("root").agg(F.min("idx").alias("__first"))
    named = durable(firsts.withColumn("k", F.row_number().over(Window.partitionBy("root.sample").orderBy("__first")) - 1).select("root", "k"))
    of = durable(of.join(named, "root").drop("root"))
    border = looked_at(sparse, of, values, cells, n, reach, close)
    found = of.select("sample", "idx", "k").unionByName(border)
    return rows.join(found, ["sample", "idx"], "left")


def looked_at(sparse: DataFrame, core: DataFrame, values: list[str], cells: list[str], n: int, reach: int, close: Column) -> DataFrame:
    """(sample, idx, k) of rows that aren't core, with the first cluster that they touch."""
    met = _beside(sparse, n, reach).join(core.drop("idx"), ["sample", *cells]).where(close)
    touched = met.groupBy("sample", F.col("__i").alias("idx")).agg(F.min("k").alias("k"))
    return touched.join(core.select("sample", "idx"), ["sample", "idx"], "left_anti").select("sample", "idx", "k")


def _dbscan(rows: DataFrame, values: list[str], eps: float = 0.5, least: int = 5, n_clusters: int | None = None) -> DataFrame:
    """dbscan; with n_clusters a sample's eps shrinks by 5 % until it has so many, 200 times at most."""
    if n_clusters is None:
        return dbscan(rows, values, eps, least)
    out = []
    for _ in range(200):
        found = durable(dbscan(rows, values, eps, least))
        enough = durable(found.groupBy("sample").agg((F.max(F.coalesce("k", F.lit(-1))) + 1).alias("n")).where(F.col("n") >= n_clusters).select("sample"))
        out.append(found.join(enough, "sample", "left_semi"))
        rows = durable(rows.join(enough, "sample", "left_anti"))
        if rows.isEmpty():
            break
        eps *= 0.95
    else:
        out.append(found.join(enough, "sample", "left_anti"))
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return all_


METHODS = {"kmeans": k_means, "meanshift": mean_shift, "dbscan": _dbscan}


def clustered_by_sample(df: DataFrame, values: list[str], method: str = "meanshift", min_data: int = 10, normalise: bool = False, **how) -> DataFrame:
    """df with cluster, for each sample by itself: -2 for rows with a null, and for all rows of a sample with min_data or fewer others. Several values are brought to equal deviations first."""
    if method not in METHODS:
        raise ValueError(f"method is one of {sorted(METHODS)}, not {method!r}")
    rows = _ready(df, values).select("sample", "idx", *[F.col(v).cast("double").alias(v) for v in values])
    stats = rows.groupBy("sample").agg(F.count(F.lit(1)).alias("__n"), *[x for v in values for x in (F.avg(v).alias(f"__m_{v}"), F.stddev_pop(v).alias(f"__s_{v}"))]).where(F.col("__n") > min_data)
    scale = normalise or len(values) > 1
    z = lambda v: ((F.col(v) - F.col(f"__m_{v}")) / F.when(F.col(f"__s_{v}") > 0, F.col(f"__s_{v}")).otherwise(1.0)).alias(v)
    rows = durable(rows.join(stats, "sample").select("sample", "idx", *[z(v) if scale else F.col(v) for v in values]))
    found = durable(METHODS[method](rows, values, **how).select("sample", "idx", F.col(values[0]).alias("__x"), "k"))
    order = found.where("k IS NOT NULL").groupBy("sample", "k").agg(F.avg("__x").alias("__mean"))
    rank = (F.row_number().over(Window.partitionBy("sample").orderBy("__mean", "k")) - 1).cast("int")
    order = order.select("sample", "k", rank.alias("cluster"))
    labels = found.join(order, ["sample", "k"], "left").select("sample", "idx", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return df.join(labels, ["sample", "idx"], "left").withColumn("cluster", F.coalesce("cluster", F.lit(-2)))


def principal_components(df: DataFrame, values: list[str], k: int = 2) -> tuple[DataFrame, np.ndarray]:
    """df with pc1 ... pck (null where a value is), and the loadings, one row for each value. Signs are such that each component's largest loading is positive."""
    steps = [VectorAssembler(inputCols=values, outputCol="__x"), StandardScaler(inputCol="__x", outputCol="__z", withMean=True, withStd=False), PCA(k=k, inputCol="__z", outputCol="__p")]
    model = Pipeline(stages=steps).fit(_ready(df, values))
    loadings = model.stages[-1].pc.toArray()
    sign = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    mean = model.stages[1].mean.toArray()
    score = lambda j: sum(((F.col(v) - float(mean[i])) * float(loadings[i, j] * sign[j]) for i, v in enumerate(values)), F.lit(0.0))
    return df.withColumns({f"pc{j + 1}": score(j) for j in range(k)}), loadings * sign
