"""Quality classifier: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader.

A word is a run of letters and digits or a run of other visible characters, so
that junk such as "$$$" or "|" is a word too. Unigrams and bigrams are hashed
into 2 ** BITS places, and a word that is said again, next or after one other,
is hashed once more as a repetition. A text is the vector of its places with
their damped counts, scaled to length 1. A score is the sigmoid of one sparse
dot product. The fit reads a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import without

ADDED = ("held_out", "score", "predicted")
BITS = 18
#: Labelled rows that the fit reads at most, the first of these in order of a hash of their key; and how often it reads each.
SAMPLE, ROUNDS = 6000, 3
#: Per-coordinate rates and penalties of the fit.
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 0.1
THRESHOLD = 0.7
WORDS = re.compile(rb"[0-9A-Za-z\x80-\xff]+|[^\x00-\x200-9A-Za-z\x7f-\xff]+")
#: Places after the constant's: a word is the one before, or the one before that.
REPEATS = 2
#: Words of a text that are hashed at once.
BLOCK = 1 << 16


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text; place 0 is the constant, the only one of an empty text."""
    data, last = (text or "").encode(), None
    places: list[np.ndarray] = []
    words: list[int] = []

    def take() -> None:
        h = np.array(words, np.uint64)
        pairs = (h[:-1] * np.uint64(0x9E3779B1) + h[1:]) if len(h) > 1 else h[:0]
        both = np.concatenate([h if last is None else h[1:], pairs])
        both = (both * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)
        at, n = np.unique(both.astype(np.int64), return_counts=True)
        again = [int((h[k:] == h[:-k]).sum()) for k in range(1, REPEATS + 1)]
        places.append(np.stack([np.concatenate([np.arange(1, REPEATS + 1), np.maximum(at, REPEATS + 1)]), np.concatenate([again, n])]))

    for m in WORDS.finditer(data) if len(data) > BLOCK * 8 else ():
        words.append(crc32(m[0]))
        if len(words) > BLOCK:
            take()
            last = words[-1]
            words = [last]
    if not places:
        words = list(map(crc32, WORDS.findall(data)))
    if len(words) > (last is not None):
        take()
    if not places:
        return np.zeros(1, np.int64), np.ones(1)
    at, n = places[0] if len(places) == 1 else np.concatenate(places, axis=1)
    if len(places) > 1:
        at, back = np.unique(at, return_inverse=True)
        n = np.bincount(back, n)
    x = np.log1p(n)
    return np.concatenate([[0], at]), np.concatenate([[1.0], x / np.sqrt(x @ x)])


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(texts: list[str | None], labels: list[int], seed: int = 7) -> np.ndarray:
    """The weights (float32, 2 ** BITS) after ROUNDS passes of FTRL-proximal, row by row in an order that the seed fixes."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rows = [features(t) for t in texts]

    def weights(at: np.ndarray) -> np.ndarray:
        a = z[at]
        penalty = np.where(at == 0, 0.0, L1)
        return np.where(np.abs(a) <= penalty, 0.0, -(a - np.sign(a) * penalty) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    rng = np.random.default_rng(seed)
    for _ in range(ROUNDS):
        for i in rng.permutation(len(rows)).tolist():
            at, x = rows[i]
            w = weights(at)
            g = (sigmoid(w @ x) - labels[i]) * x
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            np.add.at(z, at, g - step * w)
            np.add.at(n, at, g * g)
    return weights(np.arange(1 << BITS)).astype(np.float32)


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality") -> np.ndarray:
    """Fits in one task, on SAMPLE rows at most; gives 2 ** BITS weights to the driver.

    Rows that are held out, and rows whose key or label is null, are not read.
    A key that is labelled more than once has its largest label. Labels of
    documents that aren't here take no place in the sample. Repeated documents
    are repeated rows. Without any labelled row all weights are 0.
    """
    known = labels.select(F.col(key).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL").groupBy("k").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t")).where(~held_out(F.col("k")))
    # The keys are drawn before the texts are read, of those that have a document here.
    keys = known.where(~held_out(F.col("k"))).join(rows.select("k"), "k", "left_semi").orderBy(F.xxhash64("k"), "k").limit(SAMPLE)
    chosen = rows.join(F.broadcast(keys), "k").orderBy(F.xxhash64("k"), "k", "t").limit(SAMPLE)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, ys = [], []
        for b in batches:
            texts += b.column("t").to_pylist()
            ys += b.column("y").to_pylist()
        yield pa.RecordBatch.from_pydict({"w": [fit(texts, ys).tobytes()]})

    fitted = chosen.select("t", "y").coalesce(1).mapInArrow(one, "w binary").first()  # none where no row leaves no task
    return np.frombuffer(fitted[0], np.float32) if fitted else np.zeros(1 << BITS, np.float32)


def score(docs: DataFrame, weights: np.ndarray, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds held_out, score (0 to 1) and predicted (1 from THRESHOLD on) to every document.

    Null and empty texts have the score of the constant alone. A null key is
    not held out. Repeated rows are scored alike; an empty table gives an empty
    one. Input columns named as an added one are replaced; others are kept.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # 2 ** BITS floats

    @F.pandas_udf(T.DoubleType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        w = sent.value.astype(np.float64)
        for texts in batches:
            yield pd.Series([float(sigmoid(w[at] @ x)) for at, x in map(features, texts)], dtype="float64")

    out = without(docs, *ADDED).withColumn("held_out", held_out(F.col(key))).withColumn("score", of(F.col(text)))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
