"""Textures that are kept between loads: sums and counts by texel, added to by every batch of points.

A batch writes its own sums, few rows beside its points, to a folder of its number, so one that runs twice replaces itself. Every ``EVERY`` batches all sums are merged to a base, from which
reading goes on; so neither a load nor a reading grows with the number of loads. Sums are whole numbers: any order and split of the points gives the texture of one load.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Batches between two bases.
EVERY = 16
TEXEL, CHANNELS = ("px", "py", "tx", "ty"), ("r", "g", "b", "a")
SUMS = "px int, py int, tx int, ty int, r bigint, g bigint, b bigint, a bigint, n bigint"


def sums(points: DataFrame) -> DataFrame:
    """Sums of the channels and counts by texel of points (px, py, tx, ty, r, g, b and, if there is one, a; else 255)."""
    alpha = F.col("a") if "a" in points.columns else F.lit(255)
    rows = points.select(*TEXEL, *"rgb", alpha.alias("a"))
    return rows.groupBy(*TEXEL).agg(*[F.sum(c).cast("long").alias(c) for c in CHANNELS], F.count("*").alias("n"))


def merged(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*TEXEL).agg(*[F.sum(c).alias(c) for c in (*CHANNELS, "n")])


def _table(spark: SparkSession, folder: str, upto: int) -> DataFrame:
    """All sums of the batches up to a number: of the last base before it and of the batches since."""
    base = (upto + 1) // EVERY * EVERY - 1
    paths = [f"{folder}/base/batch={base}"] * (base >= 0) + [f"{folder}/sums/batch={k}" for k in range(base + 1, upto + 1)]
    return spark.read.schema(SUMS).parquet(*paths)


def load(stream: DataFrame, folder: str) -> int:
    """Adds what a stream of points has now to the textures below folder; the number of the last batch with points so far (-1: none)."""

    def put(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums(batch).write.mode("overwrite").parquet(f"{folder}/sums/batch={number}")
        if (number + 1) % EVERY == 0:
            earlier = [_table(spark, folder, number - EVERY)] if number >= EVERY else []
            parts = spark.read.schema(SUMS).parquet(*[f"{folder}/sums/batch={k}" for k in range(number - EVERY + 1, number + 1)])
            for part in earlier:
                parts = parts.unionByName(part)
            merged(parts).write.mode("overwrite").parquet(f"{folder}/base/batch={number}")

    stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return last(stream.sparkSession, folder)


def last(spark: SparkSession, folder: str) -> int:
    """The number of the last batch that had points."""
    try:
        found = spark.read.schema(f"{SUMS}, batch int").parquet(f"{folder}/sums")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return -1
    return found.agg(F.coalesce(F.max("batch"), F.lit(-1))).first()[0]


def textures(spark: SparkSession, folder: str, least: int = 2) -> DataFrame:
    """px, py, tx, ty, mean r, g, b and a and n of the texels of more than least points, over all loads."""
    upto = last(spark, folder)
    if upto < 0:
        return spark.createDataFrame([], SUMS)
    found = merged(_table(spark, folder, upto)).filter(F.col("n") > least)
    return found.select(*TEXEL, *[F.floor(F.col(c) / F.col("n")).cast("int").alias(c) for c in CHANNELS], "n")
