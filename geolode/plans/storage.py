"""Where running queries keep what they write: the session's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def folder(spark: SparkSession, kind: str) -> str:
    """A new folder name below spark.checkpoint.dir (or the context's checkpoint folder); a temporary folder where neither is set on one machine."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        top = tempfile.mkdtemp(prefix="spark-checkpoints-")
    return f"{top.rstrip('/')}/{kind}-{uuid.uuid4()}"


def kept(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder, read again."""
    path = f"{folder(df.sparkSession, 'kept')}/table"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def without_clash(df: DataFrame) -> str:
    """A prefix that no column of df begins with, whatever the case, for an operator's own columns."""
    mark = "__"
    while any(c.lower().startswith(mark) for c in df.columns):
        mark += "_"
    return mark


def placed_in_order(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with its place (as column name), from 1 on in a total order, numbered by many tasks: each numbers its range of the sorted rows, and what the ranges before hold is added."""
    mark = without_clash(df)
    ranges = kept(df.orderBy(*order).withColumn(f"{mark}id", F.monotonically_increasing_id()))
    part, within = F.shiftright(f"{mark}id", 33).alias(f"{mark}part"), F.col(f"{mark}id").bitwiseAND((1 << 33) - 1).alias(f"{mark}within")
    numbered = ranges.select("*", part, within)
    before = F.coalesce(F.sum("n").over(Window.orderBy(f"{mark}part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = numbered.groupBy(f"{mark}part").agg(F.count("*").alias("n")).select(f"{mark}part", before.alias(f"{mark}before"))  # a row for each task
    place = (F.col(f"{mark}before") + F.col(f"{mark}within") + 1).alias(name)
    return numbered.join(F.broadcast(sizes), f"{mark}part").select(*df.columns, place)
