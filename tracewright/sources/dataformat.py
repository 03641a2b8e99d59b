"""Instrument text files, read as a declarative format says.

A format is a dict:
  delimiter, header (row number of the names, or text that it starts with),
  footer (rows dropped at the end), pattern (what a channel's name looks like),
  time_column, time_unit (a factor to seconds, or ms, s, min),
  meta ({row number or text: [[names], regex with as many groups]}),
  replace ({regex: replacement}, applied to each line first).
Names that differ between files are settled on the driver, which sees the
distinct header rows only; channels that not all headers have are dropped.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions.names import in_order

KNOWN = {"delimiter", "header", "footer", "pattern", "time_column", "time_unit", "meta", "replace"}
UNITS = {"ms": 1e-3, "s": 1.0, "min": 60.0}
#: Distinct header rows that are settled at most.
HEADERS = 1000


def checked(fmt: dict | str) -> dict:
    """The format, from a dict or JSON text; unknown keys and units are errors."""
    fmt = json.loads(fmt) if isinstance(fmt, str) else dict(fmt)
    if unknown := set(fmt) - KNOWN:
        raise ValueError(f"unknown keys in the format: {sorted(unknown)}")
    unit = fmt.get("time_unit", "s")
    if not isinstance(unit, (int, float)) and unit not in UNITS:
        raise ValueError(f"time_unit is a number or one of {sorted(UNITS)}, not {unit!r}")
    return {"delimiter": ",", "header": 0, "footer": 0, "pattern": "([A-z]{1,2}[0-9]{1,3})", "time_column": 0, "meta": {}, "replace": {}} | fmt | {"time_unit": UNITS.get(unit, unit)}


def scan_lines(spark: SparkSession, path: str, extension: str = "") -> DataFrame:
    """(file, line_no, n_lines, line) of every file whose name contains extension."""
    # Spark gives names as in a URL.
    files = spark.read.text(path, wholetext=True).select(F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B"))).alias("file"), "value").where(F.contains("file", F.lit(extension)))
    return lines_of(files, "file", "value")


def lines_of(texts: DataFrame, file: str, text: str) -> DataFrame:
    parts = F.split(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\r?\n\z", ""), "\r?\n")
    return texts.select(F.col(file).alias("file"), F.size(parts).alias("n_lines"), F.posexplode(parts).alias("line_no", "line"))


def header_rows(lines: DataFrame, fmt: dict) -> DataFrame:
    """(file, header_no, header)."""
    if isinstance(fmt["header"], int):
        found = lines.where(F.col("line_no") == fmt["header"])
    else:
        found = lines.where(F.startswith("line", F.lit(fmt["header"])))
    return found.groupBy("file").agg(F.min("line_no").alias("header_no"), F.min_by("line", "line_no").alias("header"))


def metadata(lines: DataFrame, fmt: dict) -> DataFrame:
    """(file, meta): a map of what the patterns find, in the row they name or the first that contains their text."""
    out: list[Column] = []
    for where, (names, pattern) in fmt["meta"].items():
        hit = (F.col("line_no") == int(where)) if str(where).isdigit() else F.contains("line", F.lit(where))
        line = F.min_by(F.when(hit, F.col("line")), F.when(hit, F.col("line_no")))
        out += [F.nullif(F.regexp_extract(F.coalesce(line, F.lit("")), pattern, i + 1), F.lit("")).alias(n) for i, n in enumerate(names)]
    if not out:
        return lines.select("file").distinct().withColumn("meta", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))
    names = [n for names, _ in fmt["meta"].values() for n in names]
    return lines.groupBy("file").agg(*out).select("file", F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))]).alias("meta"))


def nested_metadata(block: Column) -> Column:
    """category:key=value;key=value lines as a map of maps."""
    rows = F.filter(F.split(block, "\n"), lambda r: F.contains(r, F.lit(":")))
    return F.map_from_arrays(F.transform(rows, lambda r: F.trim(F.substring_index(r, ":", 1))), F.transform(rows, lambda r: F.str_to_map(F.regexp_extract(r, ":(.*)$", 1), F.lit(";"), F.lit("="))))


def traces(lines: DataFrame, fmt: dict | str) -> DataFrame:
    """(sample, file, idx, time, <channel> ..., total_counts): one row for each data line, NaN as null.

    sample is the file's name without its suffix and blanks; names that repeat
    get _0, _1 and so on. The number of a row within its file is the line's.
    """
    fmt = checked(fmt)
    for pattern, by in fmt["replace"].items():
        lines = lines.withColumn("line", F.regexp_replace("line", pattern, by))
    heads = header_rows(lines, fmt)
    distinct = [r.header for r in heads.select("header").distinct().limit(HEADERS + 1).collect()]
    if len(distinct) > HEADERS:
        raise ValueError(f"over {HEADERS} different header rows")
    split = re.compile(fmt["delimiter"] if len(fmt["delimiter"]) > 1 else re.escape(fmt["delimiter"]))
    places = {h: {m[1] if (m := re.search(fmt["pattern"], c)) and m.re.groups else m[0]: i for i, c in enumerate(split.split(h)) if i != fmt["time_column"] and re.search(fmt["pattern"], c)} for h in distinct}
    common = in_order(c for c in next(iter(places.values()), {}) if all(c in p for p in places.values()))
    parts = F.split("line", split.pattern)
    number = lambda i: F.nanvl(F.get(parts, F.lit(i)).try_cast("double"), F.lit(None).cast("double"))

    def channel(c: str) -> Column:
        out = None
        for h, p in places.items():
            out = (F if out is None else out).when(F.col("header") == h, number(p[c]))
        return out.alias(c)

    data = lines.join(heads, "file").where((F.col("line_no") > F.col("header_no")) & (F.col("line_no") < F.col("n_lines") - fmt["footer"])).withColumn("__t", number(fmt["time_column"]) * float(fmt["time_unit"])).where("__t IS NOT NULL")
    idx = F.row_number().over(Window.partitionBy("file").orderBy("line_no")) - 1
    data = data.select("file", idx.alias("idx"), F.col("__t").alias("time"), *map(channel, common))
    names = heads.select("file", F.regexp_replace(F.regexp_replace("file", r"\.[^.]*$", ""), " ", "").alias("name"))
    same = Window.partitionBy("name")
    names = names.withColumn("__n", F.count(F.lit(1)).over(same)).withColumn("__k", F.row_number().over(same.orderBy("file")) - 1)
    names = names.select("file", F.when(F.col("__n") > 1, F.concat_ws("_", "name", "__k")).otherwise(F.col("name")).alias("sample"))
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) for c in common), F.lit(0.0))
    return data.join(names, "file").select("sample", "file", "idx", "time", *common, total.alias("total_counts"))


def with_universal_time(rows: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """Adds u_time: seconds since the first sample's start, days included. Without start times (sample, start) samples follow each other in order of name."""
    ends = rows.groupBy("sample").agg(F.max("time").alias("__last"))
    if starts is None:
        # One row for each sample: a session's samples are one sequence.
        seq = Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)
        offset = ends.select("sample", F.coalesce(F.sum("__last").over(seq), F.lit(0.0)).alias("__offset"))
    else:
        first = starts.agg(F.min("start").alias("__first"))
        offset = starts.join(F.broadcast(first)).select("sample", ((F.unix_micros("start") - F.unix_micros("__first")) / 1e6).alias("__offset"))  # first: one row
    return rows.join(offset, "sample", "left").withColumn("u_time", F.col("time") + F.coalesce("__offset", F.lit(0.0))).drop("__offset")


def parsed_date(text: Column, formats: tuple[str, ...] = ("d/M/yyyy h:mm:ss a", "yyyy-MM-dd HH:mm:ss", "d/M/yyyy HH:mm:ss")) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def explained(lines: DataFrame, fmt: dict | str) -> DataFrame:
    """(step, files, rows): what each step of the import finds."""
    fmt = checked(fmt)
    got = traces(lines, fmt)
    steps = [("lines", lines, "file"), ("header rows", header_rows(lines, fmt), "file"), ("metadata", metadata(lines, fmt).where(F.size("meta") > 0), "file"), ("data rows", got, "file")]
    parts = [df.agg(F.lit(n).alias("step"), F.count_distinct(c).alias("files"), F.count(F.lit(1)).alias("rows")) for n, df, c in steps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
