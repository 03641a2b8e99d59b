"""The driver tables as traces.

events: one channel; a trace for each user, in order of time. lineitem: four
channels; a trace for each supplier, in order of all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Seconds count from here.
EPOCH_US = 1704067200000000
LINE = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]
CHANNELS = {"qty": "l_quantity", "price": "l_extendedprice", "disc": "l_discount", "tax": "l_tax"}

E_SQL = f"e AS (SELECT user_id AS sample, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, (epoch_us(ts) - {EPOCH_US}) / 1e6 AS time, event_type, value FROM events)"
L_SQL = f"l AS (SELECT l_suppkey AS sample, CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY {', '.join(LINE)}) - 1 AS INT) AS idx, {', '.join(f'{c} AS {n}' for n, c in CHANNELS.items())} FROM lineitem)"


def r6(x: Column | str, name: str | None = None) -> Column:
    return F.round(x, 6).alias(name or (x if isinstance(x, str) else "value"))


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def events(spark: SparkSession, d: str) -> DataFrame:
    """(sample, idx, time, event_type, value)."""
    e = table(spark, d, "events")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    at = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("sample"), (F.row_number().over(at) - 1).alias("idx"), ((micros - EPOCH_US) / 1e6).alias("time"), "event_type", "value")


def lines(spark: SparkSession, d: str) -> DataFrame:
    """(sample, idx, qty, price, disc, tax)."""
    at = Window.partitionBy("l_suppkey").orderBy(*LINE)
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("sample"), (F.row_number().over(at) - 1).alias("idx"), *[F.col(c).alias(n) for n, c in CHANNELS.items()])
