"""Long files cut into samples: at lines that match, or between ablations."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import runs
from tracewright.operators.frames import IDX, SAMPLE


def by_regex(lines: DataFrame, pattern: str, global_rows: int = 0, trim_head: int = 0, trim_tail: int = 0) -> DataFrame:
    """(file, section, name, line_no, line): sections start where pattern matches; its first group, if it has one, is the name.

    The first global_rows lines of a file stand before each section, at -1 and
    below; trim_head and trim_tail lines of each section are dropped.
    """
    order = Window.partitionBy("file").orderBy("line_no")
    body = lines.where(F.col("line_no") >= global_rows).withColumn("__start", F.col("line").rlike(pattern).cast("int"))
    body = body.withColumn("section", F.sum("__start").over(order) - 1).where("section >= 0")
    group = F.regexp_extract("line", pattern, 1) if re.compile(pattern).groups else F.lit("")
    of = Window.partitionBy("file", "section").orderBy("line_no")
    name = F.first(F.when(F.col("__start") == 1, F.nullif(group, F.lit("")))).over(of)
    body = body.withColumn("name", F.coalesce(name, F.concat(F.lit("no_name_"), "section"))).withColumn("__k", F.row_number().over(of) - 1)
    n = F.count(F.lit(1)).over(Window.partitionBy("file", "section"))
    body = body.withColumn("__n", n).where((F.col("__k") >= trim_head) & (F.col("__k") < F.col("__n") - trim_tail))
    out = body.select("file", "section", "name", F.col("__k").alias("line_no"), "line")
    if global_rows:
        heads = lines.where(F.col("line_no") < global_rows).select("file", (F.col("line_no") - global_rows).alias("line_no"), "line")
        out = out.unionByName(out.select("file", "section", "name").distinct().join(heads, "file").select("file", "section", "name", "line_no", "line"))
    return out


def by_ablation(df: DataFrame, signal: str, names: list[str], time: str = "time", combine: bool = True) -> DataFrame:
    """df of long traces with their ablations' names as sample, cut midway between one ablation's end and the next one's start.

    The i-th ablation has the i-th name. A name that ends in "+" or "*" stands
    for all ablations that the others leave over: numbered with "+", as one
    sample with "*". Equal names are one sample if combine, else numbered. Time
    starts anew in each sample; start_offset is the seconds before it.
    """
    bounds = runs.bounds(df, signal)
    seq = Window.partitionBy(SAMPLE).orderBy("run")
    cut = F.floor((F.col("stop") + F.lead("start").over(seq)) / 2)
    bounds = bounds.withColumn("__hi", cut)
    bounds = bounds.withColumn("__lo", F.coalesce(F.lag("__hi").over(seq) + 1, F.lit(0))).withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(SAMPLE)))
    wild = next((i for i, x in enumerate(names) if x[-1:] in "+*" and x), None)
    run0 = F.col("run") - 1
    plain = F.array(*[F.lit(x) for x in names])
    if wild is None:
        named = F.get(plain, run0)
    else:
        extra = F.col("__n") - (len(names) - 1)
        stem = names[wild][:-1].rstrip("_")
        own = F.concat(F.lit(stem + "_"), (run0 - wild).cast("string")) if names[wild].endswith("+") else F.lit(stem)
        named = F.when(run0 < wild, F.get(plain, run0)).when(run0 < wild + extra, own).otherwise(F.get(plain, (run0 - extra + 1).cast("int")))
    bounds = bounds.withColumn("__name", F.coalesce(named, F.concat(F.lit("no_name_"), run0.cast("string"))))
    if not combine:
        same = Window.partitionBy(SAMPLE, "__name")
        bounds = bounds.withColumn("__name", F.when(F.count(F.lit(1)).over(same) > 1, F.concat_ws("_", "__name", (F.row_number().over(same.orderBy("run")) - 1).cast("string"))).otherwise(F.col("__name")))
    # Rows find their section by the sections of their own trace, in one array: a few names each.
    of = bounds.groupBy(SAMPLE).agg(F.array_sort(F.collect_list(F.struct(F.col("__lo").alias("lo"), F.col("__name").alias("name")))).alias("__cuts"))
    at = F.element_at(F.filter("__cuts", lambda c: c["lo"] <= F.col(IDX)), -1)["name"]
    out = df.join(of, SAMPLE).withColumn("__new", at).drop("__cuts")
    start = F.min(time).over(Window.partitionBy(SAMPLE, "__new"))
    out = out.withColumn("start_offset", start).withColumn(time, F.col(time) - start)
    out = out.withColumnRenamed(SAMPLE, "file").withColumnRenamed("__new", SAMPLE)
    return out.withColumn(IDX, (F.row_number().over(Window.partitionBy("file", SAMPLE).orderBy(IDX)) - 1).cast("int"))
