"""Metadata parsers by name, called laterally as a table function.

A parser turns a block of a file's lines into rows of a schema of its own. The
table function's schema is that of the parser it is called with: Spark asks
analyze() for it when it resolves the call. New parsers are registered by name,
and go to the workers with the call.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: For each name the columns of its rows, and what makes them from a block's lines.
PARSERS: dict[str, tuple[T.StructType, Callable[[list[str]], Iterable[tuple]]]] = {}


def parser(name: str, schema: str | T.StructType):
    """Registers a function of a list of lines under a name."""

    def add(f):
        PARSERS[name] = (schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema), f)
        return f

    return add


def table_function(registry: dict | None = None):
    """parse(name, block) as a table function over the parsers that are registered now."""
    known = dict(PARSERS if registry is None else registry)

    class Parse:
        @staticmethod
        def analyze(name: AnalyzeArgument, block: AnalyzeArgument) -> AnalyzeResult:
            if not name.isConstantExpression or name.value not in known:
                raise ValueError(f"the first argument is the name of a parser: one of {sorted(known)}")
            return AnalyzeResult(schema=known[name.value][0])

        def eval(self, name: str, block: str):
            yield from known[name][1]((block or "").splitlines())

    return F.udtf(Parse)


def _categories(lines: list[str]) -> Iterable[tuple]:
    for line in lines:
        category, found, rest = line.partition(":")
        if not found:
            continue
        for part in rest.split(";"):
            key, equal, value = part.partition("=")
            if equal:
                yield category.strip(), key.strip(), value.strip()


def _pairs(lines: list[str]) -> Iterable[tuple]:
    for n, line in enumerate(lines):
        key, found, value = line.partition("=" if "=" in line and (":" not in line or line.index("=") < line.index(":")) else ":")
        if found:
            yield n, key.strip(), value.strip()


def _register() -> None:
    text, number = T.StringType(), T.IntegerType()
    PARSERS["categories"] = (T.StructType([T.StructField(c, text) for c in ("category", "key", "value")]), _categories)
    PARSERS["pairs"] = (T.StructType([T.StructField("line", number), T.StructField("key", text), T.StructField("value", text)]), _pairs)


_register()


def parsed(blocks: DataFrame, name: str, block: str = "block") -> DataFrame:
    """blocks without their text, with a row for each that the parser finds in it; blocks in which it finds nothing go, as null ones do."""
    if name not in PARSERS:
        raise ValueError(f"no parser is named {name!r}; there are {sorted(PARSERS)}")
    return blocks.lateralJoin(table_function()(F.lit(name), F.col(block).outer())).drop(block)


def header_blocks(lines: DataFrame, first: int, last: int) -> DataFrame:
    """(file, block): rows first to last, the last not included, of each file of dataformat.lines."""
    some = lines.where(F.col("line_no").between(first, last - 1)).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("r"))  # last - first rows
    return some.select("file", F.array_join(F.transform("r", lambda x: x["line"]), "\n").alias("block"))
