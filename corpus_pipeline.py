"""From raw documents to token ids: filter by quality, drop copies and near copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns a DataFrame; all but the last return the columns of documents.
Columns of docs beside these are dropped, whatever their names. An empty table
gives an empty one in every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.durable import durable, release
from tracewright.llm import bpe, exact_dedup, mixing, quality, simhash
from tracewright.llm.common import table
from tracewright.llm.queries import TOKENIZER

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones that aren't held out, predicts as good.

    Null and empty texts have the score of the classifier's constant; without
    labels all scores are 0.5, and no document stays. Repeated rows stay or go
    alike, at any length of text.
    """
    weights = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select(COLUMNS), weights).where("predicted = 1").select(COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal without white space.

    The longest original stays, then the smallest doc_id, null last; of rows
    that are repeated one stays. Null texts are empty ones.
    """
    return exact_dedup.exact_groups(docs.select(COLUMNS)).where("kept").select(COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of linked fingerprints: that with the smallest doc_id, null last.

    Of rows that share it one stays. Null texts and those without words have
    fingerprint zero, and link like any other.
    """
    return simhash.near_representatives(docs.select(COLUMNS)).select(COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as its source's target takes it: none, once or twice.

    Null sources are a source of their own. A source without words takes
    nothing, nor does a stage without any. Repeated rows are rows of their own.
    """
    return mixing.mixed(docs.select(COLUMNS)).select(COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids) of every document that the mix took; a null or empty text has no ids."""
    coded = bpe.code(docs.select("doc_id", "source", "text"), public_tokenizers.path(TOKENIZER), decode=None)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("source mixing", mix_sources),
    ("BPE encoding", encode),
]

#: The classifier, the fingerprints and the tokenizer have no SQL.
ORACLE_SQL = None


#: Stages that read what they are given more than once, by their place in STAGES: it is written before.
READ_AGAIN = (1, 2, 3)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn. What a stage reads again is written once, and goes when the next has been."""
    docs, written = table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 in READ_AGAIN:
            docs = durable(docs)
            release(written)
            written = docs
    return docs
