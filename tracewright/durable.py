"""Rows that outlive their executors: lineage is cut by what is written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where the session names none, a temporary one if all is on this machine; else that is an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracewright-")
    return path.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """The rows, written once: rounds of a loop don't grow a plan, and no executor's loss undoes them.

    What is written stays until release(), or until Spark's cleaner finds it
    unused where spark.cleaner.referenceTracking.cleanCheckpoints is set; else
    until the folder's owner clears it.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def release(*frames: DataFrame | None) -> None:
    """Deletes what durable() wrote for these frames; neither they nor what is built on them can be read any more. Others are left alone."""
    for df in frames:
        plan = df._jdf.queryExecution().logical() if df is not None else None
        if plan is None or plan.getClass().getSimpleName() != "LogicalRDD":
            continue
        written = plan.rdd().getCheckpointFile()
        if written.isDefined():
            sc = df.sparkSession.sparkContext
            path = sc._jvm.org.apache.hadoop.fs.Path(written.get())
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
