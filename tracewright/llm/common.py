"""Helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.durable import durable, shared_dir

__all__ = ["SPACE", "WORD", "WORDS_BY_SPACE", "WORDS_OF_LETTERS", "durable", "shared_dir", "table", "whole_text", "without", "words"]

#: White space as the contracts of this subpackage mean it, and words between it.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"

#: Bytes as words() takes them, A-Z lower-cased: all but white space is of a word; or only digits, letters and whatever is beyond ASCII is.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
WORDS_BY_SPACE = _LOWER
WORDS_OF_LETTERS = bytes(b if chr(b) in "0123456789abcdefghijklmnopqrstuvwxyz" or b > 127 else 32 for b in _LOWER)
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20


def words(text: str | None, taken: bytes) -> Iterator[list[bytes]]:
    """The words of a text (null: none), in order, in lists of those of about PIECE bytes; taken is one of the two tables above.

    bytes.split() cuts at the six ASCII white space characters and only there,
    and no byte of a longer UTF-8 character is one of them.
    """
    data = (text or "").encode().translate(taken)
    if len(data) <= PIECE:
        yield data.split()
        return
    at = 0
    while at < len(data):
        end = at + PIECE
        while end < len(data) and not data[end : end + 1].isspace():  # a word is never cut
            end += 1
        yield data[at:end].split()
        at = end


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add; names match as Spark resolves them."""
    return df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])


def whole_text(name: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(name), F.lit(""))
