"""Mixing sources to target weights by systematic sampling.

Each source has a target of words. A document's expected number of copies is
target / size of its source; these are prefix-summed within the source, one
random offset is added, and a copy is emitted for each integer crossed.

The prefix sum is distributed. Within a source the documents lie in order of
size, then of a hash of their key, so the words taken differ from the target by
less than the largest document. Counts are summed by (source, size, hash cell);
sums over those tables give where a cell starts, and only the rows of one cell
are numbered together. A source, or a size within it, that holds most of the
rows is thus dealt out over all cells. Rows without a key have one hash; they are
dealt out by a hash of their text, between the cells of lower and higher hashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import WORD, without

ADDED = ("size", "source_size", "target", "copies", "taken")
#: Hexadecimal digits of a document's hash that name its cell: 256 cells for each size.
CELL_DIGITS = 2
#: Cells that rows without a key are dealt out to, for each size.
SALTS = 256


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def cell_of(key_hash: str, unkeyed: str) -> Column:
    """The cell of a row, in order of its key's hash; unkeyed is a hash of its text, where it has no key."""
    salt = F.concat(F.lit("1"), F.lpad(F.hex(F.pmod(F.col(unkeyed), F.lit(SALTS))), 2, "0"))
    side = F.when(F.col(unkeyed).isNotNull(), salt).when(F.col(key_hash) < F.md5(F.lit("")), "0").otherwise("2")
    return F.concat(F.substring(key_hash, 1, CELL_DIGITS), side)


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds target to rows (source, source_size), one for each source.

    Sources in order of code point, null last, have the weights in turn. They
    share `share` times all words by weight; none has over `cap` times its own,
    and the rest of a source so held goes to the others by weight. That is a
    common level, least(cap * size, level * weight), and the level is the
    largest that results from holding any first sources in order of cap / weight.
    """
    at = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (at % len(weights) + 1).cast("int"))
    x = sizes.withColumn("__w", w).withColumn("__most", F.lit(float(cap)) * F.col("source_size"))
    before = Window.orderBy(F.col("__most") / F.col("__w"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_words = F.lit(float(share)) * F.sum("source_size").over(every)
    left = all_words - F.coalesce(F.sum("__most").over(before), F.lit(0.0))
    level = left / (F.sum("__w").over(every) - F.coalesce(F.sum("__w").over(before), F.lit(0.0)))
    return x.withColumn("__level", level).withColumn("target", F.least("__most", F.max("__level").over(every) * F.col("__w"))).drop("__w", "__most", "__level")


def mix(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, seed: int = 42, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size, target, copies and taken (copies * size) to every document.

    Null text has size 0. A null source is a source of its own, the last. Rows
    whose key is null or repeated are documents of their own; which of several
    rows with one key, or with none and one text, has a copy more is not told apart. A source without words has
    target 0 and no copies. An empty table gives an empty one. Input columns
    named as an added one are replaced; other columns are kept. Reruns agree:
    order and offset are md5 hashes with the seed.
    """
    sized = (
        without(docs, *ADDED)
        .withColumn("size", n_words(F.col(text)))
        .withColumn("__hash", F.md5(F.coalesce(F.col(key).cast("string"), F.lit(""))))
        .withColumn("__unkeyed", F.when(F.col(key).isNull(), F.xxhash64(text)))
        .withColumn("__cell", cell_of("__hash", "__unkeyed"))
        .withColumn("__source", F.coalesce(F.concat(F.lit("="), F.col(source)), F.lit("")))
    )
    cells = sized.groupBy("__source", "size", "__cell").agg(F.count(F.lit(1)).alias("__n"))
    by_size = cells.groupBy("__source", "size").agg(F.sum("__n").alias("__n"))
    name = F.when(F.col("__source") != "", F.substring("__source", 2, 2_000_000_000))
    sources = targets(by_size.groupBy("__source").agg(F.sum(F.col("__n") * F.col("size")).alias("source_size")).withColumn("source", name), weights, share, cap).drop("source")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.substring("__source", 2, 2_000_000_000))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    sources = sources.withColumn("__rate", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))).withColumn("__offset", offset)

    ahead = lambda *order: Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    smaller = by_size.select("__source", "size", F.coalesce(F.sum("__n").over(ahead("size").partitionBy("__source")), F.lit(0)).alias("__smaller"))
    earlier = cells.select("__source", "size", "__cell", F.coalesce(F.sum("__n").over(ahead("__cell").partitionBy("__source", "size")), F.lit(0)).alias("__earlier"))
    starts = earlier.join(smaller, ["__source", "size"]).join(sources, "__source").withColumn("__start", F.col("__smaller") + F.col("__earlier")).drop("__smaller", "__earlier")

    place = F.row_number().over(Window.partitionBy("__source", "size", "__cell").orderBy("__hash", F.col(key).asc_nulls_first(), "__unkeyed"))
    crossed = lambda n: F.floor(F.col("__rate") * n + F.col("__offset"))
    rank = F.col("__start") + F.col("__place")
    copies = F.least(crossed(rank) - crossed(rank - 1), F.ceil(F.lit(cap)))
    return (
        sized.withColumn("__place", place)
        .join(starts, ["__source", "size", "__cell"])
        .withColumn("copies", copies)
        .withColumn("taken", F.col("copies") * F.col("size"))
        .select(*[F.col(c) for c in without(docs, *ADDED).columns], *ADDED)
    )


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: every document as often as it is taken, with its own columns only."""
    out = mix(docs.withColumn("__row", F.struct(*docs.columns)), **how).where("copies > 0")
    return out.select("__row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("__copy")).select("__row.*")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM d GROUP BY source
), l AS (
  SELECT *, 2.0::DOUBLE * source_size AS most,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(most, max(level) OVER () * w) AS target FROM l
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / t.source_size END AS rate,
    CAST(('0x' || substr(md5('42:' || coalesce(d.source, '')), 1, 8))::BIGINT AS DOUBLE) / 4294967296.0::DOUBLE AS offs,
    row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id NULLS FIRST) AS k
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * least(floor(rate * k + offs) - floor(rate * (k - 1) + offs), 2) AS BIGINT) AS taken FROM r
"""
