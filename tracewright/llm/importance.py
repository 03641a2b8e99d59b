"""Importance resampling towards a target: documents that look like the target's texts are drawn more often.

Words and their n-grams fall into a fixed number of buckets by a hash. A bucket
gains by how much more frequent it is in the target than in the documents, in
thousandths of a natural logarithm; a document weighs the floored mean of its
features' gains, and noise of a Gumbel distribution, which its key fixes, makes
the largest scores a sample without replacement.

Weights are looked up in one array. The n largest scores aren't sorted out of
the whole table: a radix selection counts the rows by one digit of the
composite key (score, key, features, row) at a time, from the first, keeps to
the digit that the n-th key has, and so finds that key exactly, in as many
counts as it has digits at most. Only rows up to it are then sorted by range
and numbered.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import WORDS_OF_LETTERS, durable, words

#: Bits of a digit: so many rows at most (2 ** DIGIT) are counted for it, and come to the driver.
DIGIT = 12
#: Distinct features whose bucket a task remembers.
KNOWN = 1 << 18
#: Occurrences of features that a task counts before it hands the counts on.
FLUSH = 1 << 20


def features(text: str | None, most: int) -> Iterator[tuple[int, list[bytes]]]:
    """(words, features) of each piece of a text: all runs of 1 to `most` words, joined by one space."""
    tail: list[bytes] = []
    for own in words(text, WORDS_OF_LETTERS):
        if most == 1:
            yield len(own), own
            continue
        run = tail + own
        grams = [b" ".join(run[i - n : i]) for n in range(1, most + 1) for i in range(max(n, len(tail) + 1), len(run) + 1)]
        yield len(own), grams
        tail = run[-(most - 1) :]


class Buckets(dict):
    """The bucket of a feature, remembered for the first KNOWN."""

    def __init__(self, count: int):
        super().__init__()
        self.count = count

    def __missing__(self, feature: bytes) -> int:
        at = crc32(feature) % self.count
        if len(self) < KNOWN:
            self[feature] = at
        return at


def bucket_counts(texts: DataFrame, text: str, *, most: int, buckets: int) -> np.ndarray:
    """How many features of the texts fall into each bucket, as an array of `buckets` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Buckets(buckets)
        total, seen, held = np.zeros(buckets, np.int64), Counter(), 0

        def settle() -> None:
            if seen:
                total[:] += np.bincount([of[f] for f in seen], list(seen.values()), buckets).astype(np.int64)
                seen.clear()

        for b in batches:
            for value in b.column(0):
                for _, found in features(value.as_py(), most):
                    seen.update(found)
                    held += len(found)
                    if held >= FLUSH:
                        settle()
                        held = 0
        settle()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    found = texts.select(text).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    out = np.zeros(buckets, np.int64)
    for r in found:
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's smoothed share in the target over that in the source, floored."""
    s, t = (x.astype(np.float64) for x in (source, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + len(s)) / ((s + 1) * (t.sum() + len(t))))).astype(np.int64)


def digits(value: Column) -> list[Column]:
    """The digits of a long, the first first: in their order longs are in theirs."""
    unsigned = value.bitwiseXOR(F.lit(-(1 << 63)))
    tops = range(64, 0, -DIGIT)
    return [F.shiftrightunsigned(unsigned, max(0, top - DIGIT)).bitwiseAND(F.lit((1 << min(DIGIT, top)) - 1)) for top in tops]


def first_rows(rows: DataFrame, n: int, key: list[Column]) -> Column:
    """The condition that holds for the n first rows by key, longs that are never null and tell all rows apart; n is under the number of rows.

    rows is read once for each digit that isn't skipped: the digits before the
    first in which the smallest and the largest value differ are all rows'.
    """
    ends = rows.select(*[f(c).alias(f"{name}{i}") for i, c in enumerate(key) for name, f in (("lo", F.min), ("hi", F.max))]).first()
    inside = F.lit(True)  # rows whose digits so far are those of the n-th row
    before = F.lit(False)  # rows whose digits so far are smaller
    for i, column in enumerate(key):
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        same = 64 - ((lo ^ hi) & ((1 << 64) - 1)).bit_length()
        for k, digit in enumerate(digits(column)):
            if (k + 1) * DIGIT <= same:
                continue
            counted = rows.where(inside).groupBy(digit.cast("int").alias("d")).count().collect()  # 2 ** DIGIT rows at most
            for d, m in sorted(counted):
                if n <= m:
                    break
                n -= m
            before = before | (inside & (digit < d))
            inside = inside & (digit == d)
            if n == m:  # all of them
                return before | inside
    return before | inside


def numbered(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Adds each row's place in an order that tells all rows apart, from 1: sorted by range, each range numbered from where the last ended."""
    placed = durable(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")  # monotonically_increasing_id() is the partition, then the row in it
    start, offsets = 0, {}
    for p, m in sorted(placed.groupBy(part.alias("p")).count().collect()):  # a number for each range
        offsets[p] = start
        start += m
    if not offsets:
        return placed.withColumn(name, F.lit(None).cast("long")).drop("__at")
    starts = placed.sparkSession.createDataFrame(list(offsets.items()), "__p int, __start long")
    own = placed.withColumn("__p", part).join(F.broadcast(starts), "__p")
    return own.withColumn(name, F.col("__start") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__p", "__start")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = 10, least: int = 20, most: int = 1, buckets: int = 10_000, seed: int = 2024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_features, weight, score, rank), all long, for every document.

    Of the documents with `least` words or more, percent in a hundred (rounded
    down) are drawn: those with the largest scores, ties to the smaller key.
    They are ranked from 1 in that order; others have a null rank. A null text,
    or one without words, has no features and weight 0. A null key draws its
    noise as an empty one, and loses ties. Repeated rows are documents of their
    own with equal scores and neighbouring ranks. Without target texts the
    gains are those of an empty target. An empty table gives an empty one. Keys
    are whole numbers; other columns are not returned.
    """
    gained = gains(bucket_counts(docs, text, most=most, buckets=buckets), bucket_counts(target, text, most=most, buckets=buckets))
    sent = docs.sparkSession.sparkContext.broadcast(gained)  # `buckets` numbers

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, gain = Buckets(buckets), sent.value
        for b in batches:
            n_words, n_features, weight = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, value in enumerate(b.column(1)):
                total = 0
                for n, found in features(value.as_py(), most):
                    n_words[i] += n
                    n_features[i] += len(found)
                    total += int(gain[np.fromiter(map(of.__getitem__, found), np.int64, len(found))].sum())
                weight[i] = total // n_features[i] if n_features[i] else 0
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x) for x in (n_words, n_features, weight))], ["key", "n_words", "n_features", "weight"])

    weighed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInArrow(weigh, "key long, n_words long, n_features long, weight long")
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("key").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    # Written once: narrow rows, which all counts and the sort read.
    scored = durable(weighed.withColumn("score", F.col("weight") + noise).withColumn("row", F.monotonically_increasing_id()))
    allowed = F.col("n_words") >= least
    order = [-F.col("score"), F.isnull("key").cast("long"), F.coalesce("key", F.lit(0)), F.col("n_features"), F.col("row")]
    there = scored.where(allowed).count()
    wanted = percent * there // 100
    if wanted == 0:
        drawn = F.lit(False)
    else:
        drawn = allowed & first_rows(scored.where(allowed), wanted, order) if wanted < there else allowed
    out = [F.col("key").alias(key), "n_features", "weight", "score"]
    ranked = numbered(scored.where(drawn), [F.col("score").desc(), *order[1:]], "rank")
    return ranked.select(*out, "rank").unionByName(scored.where(~drawn).select(*out, F.lit(None).cast("long").alias("rank")))


#: crc32 has no function there: it is made of its table's rule, for distinct words.
ORACLE = r"""
WITH RECURSIVE crc_step(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc_step WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY i) AS t FROM crc_step WHERE k = 8),
texts AS (
  SELECT 0 AS side, doc_id, text FROM documents UNION ALL SELECT 1, NULL, text FROM benchmark
), worded AS (
  SELECT row_number() OVER () AS r, side, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM texts
), counted AS (
  SELECT r, side, w, count(*) AS n FROM (SELECT r, side, unnest(ws) AS w FROM worded) GROUP BY r, side, w
), spelt(w, h, k, c) AS (
  SELECT w, hex(encode(w)), 0, 4294967295 FROM (SELECT DISTINCT w FROM counted)
  UNION ALL
  SELECT w, h, k + 1, xor(c >> 8, t[xor(c & 255, ('0x' || h[2 * k + 1 : 2 * k + 2])::BIGINT) + 1])
  FROM spelt, crc_table WHERE 2 * k < length(h)
), bucketed AS (
  SELECT w, xor(c, 4294967295) % 10000 AS b FROM spelt WHERE 2 * k = length(h)
), sides AS (
  SELECT b, coalesce(sum(n) FILTER (WHERE side = 0), 0) AS s, coalesce(sum(n) FILTER (WHERE side = 1), 0) AS t
  FROM counted JOIN bucketed USING (w) GROUP BY b
), gain AS (
  SELECT b, CAST(floor(1000 * ln((t + 1)::DOUBLE * ((SELECT sum(s) FROM sides) + 10000) / ((s + 1)::DOUBLE * ((SELECT sum(t) FROM sides) + 10000)))) AS BIGINT) AS g FROM sides
), weighed AS (
  SELECT r, sum(n) AS n_features, CAST(floor(sum(n * g)::DOUBLE / sum(n)) AS BIGINT) AS weight
  FROM counted JOIN bucketed USING (w) JOIN gain USING (b) WHERE side = 0 GROUP BY r
), scored AS (
  SELECT r, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || sha256(concat('2024:', doc_id))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM worded LEFT JOIN weighed USING (r) WHERE side = 0
), drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20
  QUALIFY rank <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20)
)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (r)
"""
