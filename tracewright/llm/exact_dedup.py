"""Exact deduplication by a content sort.

Normalised texts are range-partitioned by sampled splitters, each partition is
sorted (externally, where it exceeds memory), so that equal texts lie side by
side, and a window compares neighbours in full. Spark's range exchange, sort
and window do just these three. The order is by a text's first HEAD characters,
then by a hash of all of it, then by the text; splitters are sampled on the
driver, so they have the first two only and stay small however long texts are.

A text that a large share of the rows holds would meet in one partition. A
sample finds such texts, HOT at most; their rows are sorted by (text, salt),
which splitters can cut. What the salts of such a text share, its winner and
its number of rows, is a grouped aggregate that combines before it is shuffled,
HOT texts at most. All rows count: the sample only steers the salt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import whole_text, without

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
#: Texts at most that are salted, and salts of each. A text that isn't among the HOT most frequent has under 1 / HOT of the rows.
HOT, SALTS = 1000, 256
#: Characters of a text that splitters have.
HEAD = 16
#: Share of the rows from which frequent texts are told, and how often one must occur among them.
SAMPLE, OFTEN = 0.02, 12


def normalised(text: Column) -> Column:
    for c in " \t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def hot_texts(docs: DataFrame, text: str) -> list[int]:
    """Hashes of the most frequent texts of a sample: HOT numbers at most."""
    found = docs.sample(SAMPLE, seed=7).select(F.xxhash64(normalised(whole_text(text))).alias("h")).groupBy("h").count().where(F.col("count") >= OFTEN)
    return [r.h for r in found.orderBy(F.desc("count"), "h").limit(HOT).collect()]


def exact_groups(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds keep_id, group_size, kept and text_sha256 to every document.

    Texts are equal when they are so after deleting white space. The row with
    the most code points in its original text stays, of those the one with the
    smallest key. Null text counts as empty; a null key comes after all others.
    Of rows that tie in all this, repeated rows, one stays. An empty table gives
    an empty one. Input columns named as an added one are replaced; other
    columns are kept.
    """
    rows = without(docs, *ADDED).withColumn("__norm", normalised(whole_text(text))).withColumn("__long", F.length(whole_text(text)))
    rows = rows.withColumn("__head", F.substring("__norm", 1, HEAD)).withColumn("__hash", F.xxhash64("__norm"))
    hot = hot_texts(docs, text)
    split = ["__head", "__hash"]
    salt = lambda k: F.pmod(F.xxhash64(k), F.lit(SALTS)).cast("int")
    if hot:
        rows = rows.withColumn("__salt", F.when(F.col("__hash").isin(hot), salt(F.col(key))).otherwise(-1))
        split += ["__salt"]
    equal = Window.partitionBy(*split, "__norm")
    best = equal.orderBy(F.desc("__long"), F.col(key).asc_nulls_last())
    winner = F.struct(F.col("__long").alias("l"), F.col(key).alias("k"))
    done = (
        rows.repartitionByRange(*split)
        .withColumn("__place", F.row_number().over(best))
        .withColumn("__best", F.first(winner).over(best))
        .withColumn("__n", F.count(F.lit(1)).over(equal))
        .withColumn("text_sha256", F.sha2("__norm", 256))
    )
    columns = without(docs, *ADDED).columns
    if not hot:
        return done.select(*columns, F.col("__best.k").alias("keep_id"), F.col("__n").alias("group_size"), (F.col("__place") == 1).alias("kept"), "text_sha256")
    first = F.min(F.struct((-F.col("__long")).alias("l"), F.col(key).isNull().alias("n"), F.col(key).alias("k")))
    merged = rows.where("__salt >= 0").groupBy("__hash", "__norm").agg(first.alias("__b"), F.count(F.lit(1)).alias("__all"))
    merged = merged.select(F.sha2("__norm", 256).alias("text_sha256"), salt(F.col("__b.k")).alias("__won"), F.col("__b.k").alias("__keep"), "__all")
    # One row for each salted text: HOT at most.
    out = done.drop("__norm").join(F.broadcast(merged), "text_sha256", "left")
    salted = F.col("__salt") >= 0
    return out.select(
        *columns,
        F.when(salted, F.col("__keep")).otherwise(F.col("__best.k")).alias("keep_id"),
        F.when(salted, F.col("__all")).otherwise(F.col("__n")).alias("group_size"),
        ((F.col("__place") == 1) & (~salted | (F.col("__salt") == F.col("__won")))).alias("kept"),
        "text_sha256",
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY n DESC, doc_id NULLS LAST)
"""
