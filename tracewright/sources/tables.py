"""Small keyed tables, map scans, and what is written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F



def references(spark: SparkSession, path: str) -> DataFrame:
    """(srm, item, mol_g, mol_g_err) of a reference-material table; rows that are all null are dropped."""
    rows = spark.read.csv(path, header=True, enforceSchema=False, inferSchema=False).dropna("all")
    return rows.select(F.col("SRM").alias("srm"), F.col("Item").alias("item"), F.col("`mol/g`").try_cast("double").alias("mol_g"), F.col("`mol/g_err`").try_cast("double").alias("mol_g_err"))


def concentrations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="sample string, int_stand_massfrac double")


def vertices(text: Column) -> Column:
    """x,y,z;x,y,z as an array of points."""
    return F.transform(F.filter(F.split(text, ";"), lambda p: F.trim(p) != ""), lambda p: F.struct(*[F.get(F.split(p, ","), F.lit(i)).try_cast("double").alias(n) for i, n in enumerate("xyz")]))


def settings(text: Column) -> Column:
    return F.str_to_map(text, F.lit(";"), F.lit("="))


def image_map(text: Column) -> Column:
    """Size, centre and extent of an image-map document."""
    kind = "struct<Size: struct<_Width: double, _Height: double>, Center: struct<_X: double, _Y: double>>"
    return F.from_xml(text, kind, {"rowTag": "ImageMap"})


def on_scan(rows: DataFrame, time: str, vertex_list: str, scan_speed: str, offset: float = 0.0) -> DataFrame:
    """Adds x, y and d: the place on the scan's line of two vertices after 100 * time / speed, as instruments' exports mean it, and the distance from its start."""
    a, b = F.col(vertex_list)[0], F.col(vertex_list)[1]
    length = F.sqrt(F.pow(b["x"] - a["x"], 2) + F.pow(b["y"] - a["y"], 2))
    d = F.try_divide(100 * F.col(time), F.col(scan_speed)) + offset
    return rows.withColumn("d", d).withColumn("x", a["x"] + (b["x"] - a["x"]) * F.try_divide(F.col("d"), length)).withColumn("y", a["y"] + (b["y"] - a["y"]) * F.try_divide(F.col("d"), length))


def write_traces(df: DataFrame, path: str, values: list[str], masks: dict[str, Column] | None = None, form: str = "csv") -> None:
    """One folder for each sample; values outside their own mask are null, each by itself."""
    masks = masks or {}
    out = df.select("sample", "idx", "time", *[F.when(F.coalesce(masks[v], F.lit(False)), F.col(v)).alias(v) if v in masks else F.col(v) for v in values])
    writer = out.repartition("sample").sortWithinPartitions("sample", "idx").write.mode("overwrite").partitionBy("sample")
    writer.option("header", True).csv(path) if form == "csv" else writer.format(form).save(path)


def read_traces(spark: SparkSession, path: str, form: str = "csv") -> DataFrame:
    if form == "csv":
        return spark.read.csv(path, header=True, inferSchema=True, comment="#").dropna("all").withColumn("sample", F.col("sample").cast("string"))
    return spark.read.format(form).load(path)


def write_stats(long: DataFrame, path: str, times: DataFrame | None = None) -> None:
    """Statistics as CSV, with ablation times joined on sample and rep where they are given."""
    out = long.join(times, [c for c in ("sample", "rep") if c in long.columns], "left") if times is not None else long
    out.write.mode("overwrite").option("header", True).csv(path)


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """Statistics as they were exported, (statistic, sample, rep, values ...); rep where there is one, cells that are no number are null."""
    rows = spark.read.csv(path, header=True, comment="#").dropna("all")
    keys = [c for c in ("statistic", "sample", "rep") if c in rows.columns]
    return rows.select(*[F.col(c).try_cast("int") if c == "rep" else F.col(c) for c in keys], *[F.col(f"`{c}`").try_cast("double").alias(c) for c in rows.columns if c not in keys])
