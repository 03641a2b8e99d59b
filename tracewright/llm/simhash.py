"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut into segments; two that differ in at most `bits` places
differ in at most bits // segments of one segment at least. So every
fingerprint is filed under each of its segments, each looks up the small
Hamming ball around each of its own segments, and what it meets is verified
over all places. Few segments are long keys with large balls: how many there
are follows from the number of fingerprints, so that a look-up meets few rows
by chance at every size. Links join into components by rounds of large and
small stars.

Work is on distinct fingerprints: copies, however many, are one node. A group
of near copies can still have many fingerprints in one bucket. Therefore each
bucket first links its members to its smallest one (a row for each member).
The ball look-up then returns only links between components that are still
apart: a fingerprint looks only into buckets that hold a larger component, and
meets only members of larger ones, so that the inside of a group is never
written out as pairs. A bucket that is still large is filed once more, under
bits + 1 pieces of the places outside the segment: of two fingerprints that
differ in `bits` places one piece at least is equal.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import durable, without

ADDED = ("fingerprint", "component_id")
#: Segments for up to so many fingerprints; 32-bit segments beyond. At this number a look-up in 21-bit segments meets about as many rows by chance as the larger balls have values.
SEGMENTS, MANY = 3, 40_000_000
#: Members of a bucket from which on it is filed by pieces too.
CROWD = 256
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Hashes whose bits are counted at once.
BLOCK = 1 << 15


def simhash(text: str | None, words: int = 4, seed: int = 42) -> int:
    """The fingerprint as an unsigned number; 0 for a text without words."""
    # bytes.split() cuts at the six ASCII white space characters, and only there.
    parts = (text or "").encode().translate(LOWER).split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(parts) - words + 1].tolist()
    ends = ends[words - 1 :].tolist()
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        some = np.array([digest(joined[i:j], seed) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)], "<u8")
        counts += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * counts > len(starts)))


def fingerprints(text: Column, words: int = 4, seed: int = 42) -> Column:
    """The fingerprint as a signed long with the same bits."""

    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([simhash(t, words, seed) for t in texts], np.uint64).view(np.int64))

    return of(text)


def segments_for(n: int) -> int:
    return SEGMENTS if n <= MANY else 2


def segment_bounds(count: int) -> list[tuple[int, int]]:
    """First place and width of each segment."""
    cuts = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def segments(fp: Column, count: int) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1)).alias("value")) for i, (a, w) in enumerate(segment_bounds(count))])


def ball(fp: Column, radius: int, count: int) -> Column:
    """(segment, value) for every value within radius of a segment of fp."""

    def around(i: int, a: int, w: int) -> Column:
        flips = {0}
        for _ in range(radius):
            flips |= {f ^ (1 << b) for f in flips for b in range(w)}
        own = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << w) - 1))
        return F.transform(F.array(*[F.lit(f).cast("long") for f in sorted(flips)]), lambda x: F.struct(F.lit(i).alias("segment"), own.bitwiseXOR(x).alias("value")))

    return F.flatten(F.array(*[around(i, a, w) for i, (a, w) in enumerate(segment_bounds(count))]))


def pieces(fp: Column, segment: Column, bits: int, count: int) -> Column:
    """The places outside a segment, in bits + 1 pieces: (piece, the fingerprint with all other places 0)."""
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    by = []
    for a, w in segment_bounds(count):
        rest = [p for p in range(64) if not a <= p < a + w]
        cuts = [len(rest) * j // (bits + 1) for j in range(bits + 2)]
        by.append(F.array(*[F.struct(F.lit(j).alias("piece"), fp.bitwiseAND(F.lit(signed(sum(1 << p for p in rest[x:y])))).alias("part")) for j, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False))]))
    return F.element_at(F.array(*by), segment + 1)


def near(a: str, b: str, bits: int) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= bits


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node that it reaches.

    Alternates large stars (a node's larger neighbours move to its smallest
    one) and small stars (its smaller ones do) until no edge changes. Each
    round is a grouped minimum and a join; its edges go to the checkpoint folder.
    """
    edges = durable(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        # The smaller neighbours of b, and b itself, move to the smallest of them.
        least = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(least, "b")
        edges = durable(small.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(least.select(F.col("m").alias("a"), "b")).where("a < b").distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    # All is stars now: every edge leads from a root to one of its nodes.
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))


def rooted(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Adds root to nodes (fp); a node without edges is its own."""
    return nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def shuffled(rows: DataFrame) -> DataFrame:
    """Exploded rows that are about to be joined. Spark takes them to be as many as before, and would collect and broadcast them while the table that they come from is small."""
    return rows.hint("merge")


def linked(fps: DataFrame, bits: int) -> DataFrame:
    """(fp, root) for distinct fps: fingerprints of one component have the same root."""
    key, count = ["segment", "value"], segments_for(fps.count())
    filed = fps.select("fp", F.explode(segments(F.col("fp"), count)).alias("s")).select("fp", "s.segment", "s.value")
    # What is joined to a bucket's rows is written first: Spark can then split the rows of a large bucket.
    least = durable(filed.groupBy(*key).agg(F.min("fp").alias("hub")))
    hubs = shuffled(filed).join(least, key).where(near("fp", "hub", bits) & (F.col("fp") != F.col("hub")))
    first = durable(rooted(fps, components(hubs.select(F.col("hub").alias("a"), F.col("fp").alias("b")))))
    table = first.select(F.col("fp").alias("b"), F.col("root").alias("rb"), F.explode(segments(F.col("fp"), count)).alias("s")).select("b", "rb", "s.segment", "s.value")
    held = durable(table.groupBy(*key).agg(F.max("rb").alias("largest"), F.count(F.lit(1)).alias("n")))
    # A fingerprint is a small row and its balls are many: they are dealt out again, which Spark would lay together.
    spread = first.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    probe = spread.select(F.col("fp").alias("a"), F.col("root").alias("ra"), F.explode(ball(F.col("fp"), bits // count, count)).alias("s")).select("a", "ra", "s.segment", "s.value")
    probe = durable(shuffled(probe).join(held, key).where("ra < largest").drop("largest"))
    asked = durable(probe.groupBy(*key).agg(F.min("ra").alias("smallest"), F.max("n").alias("n")))
    table = shuffled(table).join(asked, key).where("rb > smallest").drop("smallest")

    def crowd(rows: DataFrame, fp: str) -> DataFrame:
        whole = F.array(F.struct(F.lit(-1).alias("piece"), F.lit(0).cast("long").alias("part")))
        split = F.explode(F.when(F.col("n") > CROWD, pieces(F.col(fp), F.col("segment"), bits, count)).otherwise(whole))
        return rows.select("*", split.alias("p")).select("*", "p.piece", "p.part").drop("p", "n")

    met = shuffled(crowd(probe, "a")).join(crowd(table, "b"), [*key, "piece", "part"]).where((F.col("ra") < F.col("rb")) & near("a", "b", bits))
    second = components(met.select(F.col("ra").alias("a"), F.col("rb").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("top"))
    return first.join(second, "root", "left").select("fp", F.coalesce("top", "root").alias("root"))


def grouped(rows: DataFrame, bits: int) -> DataFrame:
    """Adds root, the same for all of a component, and component_id to rows (key, fp, ...)."""
    nodes = durable(rows.groupBy("fp").agg(F.min("key").alias("least")))
    roots = durable(linked(nodes.select("fp"), bits))
    # The component's smallest key is counted by root and joined to the fingerprints by it: both are written before, so that a large component's are split.
    ids = durable(nodes.join(roots, "fp").groupBy("root").agg(F.min("least").alias("component_id")))
    named = durable(roots.join(ids, "root").select("fp", "root", "component_id"))
    return rows.join(named, "fp")


def near_groups(docs: DataFrame, *, bits: int = 4, words: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint, component_id) for every document.

    fingerprint is 16 hexadecimal digits, component_id the smallest key that is
    reachable by links of at most `bits` differing places. Null and empty texts,
    and those of white space, have fingerprint zero and link like any other. A
    null key is never the smallest, unless no other is reached: then
    component_id is null. Repeated rows are one row each. An empty table gives
    an empty one. Other columns are not returned.
    """
    # Narrow rows: the texts are read once.
    rows = durable(docs.select(F.col(key).alias("key"), fingerprints(F.col(text), words, seed).alias("fp")))
    return grouped(rows, bits).select(F.col("key").alias(key), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def near_representatives(docs: DataFrame, *, bits: int = 4, words: int = 4, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without all but one document of each component of near_groups: the one with the smallest key, null last.

    Of documents that share it, the one whose text has the smallest digest
    stays, and of rows that share the text too, the first in order of the other
    columns; documents of other components that share a key are not touched.
    """
    digest = F.sha2(F.coalesce(F.col(text), F.lit("")), 256)
    rows = durable(docs.select(F.col(key).alias("key"), digest.alias("digest"), fingerprints(F.col(text), words, seed).alias("fp")))
    heads = grouped(rows, bits).groupBy("root").agg(F.min(F.struct(F.isnull("key").alias("last"), "key", "digest")).alias("h")).select(F.col("h.key").alias("__key"), F.col("h.digest").alias("__digest"))
    heads = durable(heads)
    found = docs.withColumn("__own", digest)
    kept = found.join(heads, (found["__own"] == heads["__digest"]) & found[key].eqNullSafe(heads["__key"]), "left_semi")
    # Rows that share key and text are put in order only where there are any: whole texts are shuffled once otherwise.
    same = rows.groupBy("key", "digest").count().where("count > 1")
    if same.isEmpty():
        return kept.drop("__own")
    rest = [F.to_json(F.struct(*[c for c in docs.columns if c not in (key, text)]))] if set(docs.columns) - {key, text} else [F.lit(1)]
    order = Window.partitionBy("__own", key).orderBy(*rest, F.col(text).asc_nulls_first())
    return kept.withColumn("__nth", F.row_number().over(order)).where("__nth = 1").drop("__nth", "__own")
