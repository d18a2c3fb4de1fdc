"""A folder of LAS files as a table of headers, and reads that are planned from it.

Spark lists the folder, tasks read the headers (a few KB of each file), and the table is kept as Parquet. Reads are then plans over the table: bounds are a filter that is
pushed to its scan, so files outside are neither opened nor named in a task; points are cut into ranges, dealt evenly over as many tasks as their bytes ask for, and read by
ranges. Neither listing nor pruning nor reading is a loop on the driver.

A file that can't be read as LAS raises an error that names it. An empty folder is an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.sources import las

#: Points of a range, and bytes that a task reads.
RANGE, TASK_BYTES = 1_000_000, 128 << 20


def listed(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """path and length of the point files of a folder."""
    files = las.list_files(spark, folder, recursive)
    return files.filter(las.is_point_file(F.col("path")))


def headers(files: DataFrame) -> DataFrame:
    """The header of each file (path), read by tasks; path stays as it was listed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    yield from las.read_file(path, "headers")
                except (ValueError, OSError) as e:
                    raise ValueError(f"{path}: {e}") from e

    return files.select("path").mapInArrow(run, las.HEADERS)


def written(spark: SparkSession, folder: str, to: str, recursive: bool = True) -> DataFrame:
    """The catalogue of a folder, written as a table. Where there is one already, only files that it doesn't have with their present size are read and added."""
    files = listed(spark, folder, recursive)
    try:
        known = spark.read.schema(las.HEADERS).parquet(to)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = None
    if known is not None:
        had = known.select(F.col("path").alias("had"), "file_size")
        files = files.join(had, (F.col("path") == F.col("had")) & (F.col("length") == F.col("file_size")), "left_anti")
    spread = max(1, spark.sparkContext.defaultParallelism)
    headers(files.select("path").repartition(spread)).write.mode("append").parquet(to)
    return spark.read.schema(las.HEADERS).parquet(to)


def present(catalogue: DataFrame, folder: str, recursive: bool = True) -> DataFrame:
    """The rows of a catalogue whose files are there with the size that they have in it."""
    now = listed(catalogue.sparkSession, folder, recursive).select(F.col("path").alias("there"), "length")
    return catalogue.join(now, (F.col("path") == F.col("there")) & (F.col("file_size") == F.col("length")), "left_semi")


def inside(catalogue: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """The files whose bounds meet a box (x0, y0, x1, y1); plain comparisons, which the scan takes over."""
    x0, y0, x1, y1 = map(float, box)
    return catalogue.filter((F.col("min_x") <= x1) & (F.col("max_x") >= x0) & (F.col("min_y") <= y1) & (F.col("max_y") >= y0))


def near(catalogue: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """The files that meet any of boxes (x0, y0, x1, y1), each once: both go to the cells of a grid, so it is a join on keys."""
    from geolode.operators import grid

    cells = lambda df, names: grid.covered_cells(df, *[F.col(n) for n in names], size=size)
    sides = cells(catalogue.select("path", "min_x", "min_y", "max_x", "max_y"), ("min_x", "min_y", "max_x", "max_y"))
    wanted = cells(boxes.select("x0", "y0", "x1", "y1").distinct(), ("x0", "y0", "x1", "y1"))
    meets = (F.col("min_x") <= F.col("x1")) & (F.col("max_x") >= F.col("x0")) & (F.col("min_y") <= F.col("y1")) & (F.col("max_y") >= F.col("y0"))
    return catalogue.join(sides.join(wanted, ["px", "py"]).filter(meets).select("path").distinct(), "path", "left_semi")


def rows(catalogue: DataFrame, what: str = "points", box: tuple[float, float, float, float] | None = None, chunk: int = 0, points_per_range: int = RANGE) -> DataFrame:
    """chunks, chunk_points or points (as the ``las`` source gives them) of the files of a catalogue."""
    files = catalogue if box is None else inside(catalogue, box)
    of = F.greatest(F.ceil(F.col("n_points") / points_per_range), F.lit(1)).cast("int") if what == "points" else F.lit(1)
    ranges = files.select("path", of.alias("of"), "file_size").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    total, n = files.agg(F.sum("file_size"), F.count("*")).first()  # of the table, not of the files
    read = total or 0 if what == "points" else 64 * 1024 * (n or 0)
    tasks = max(1, min(max(catalogue.sparkSession.sparkContext.defaultParallelism, -(-read // TASK_BYTES)), 100_000))
    dealt = ranges.repartition(tasks, "path", "share").select("path", "share", "of")
    limits = None if box is None else [float(v) for v in box]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, share, n_shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield from las.read_file(path, what, chunk, share, n_shares, limits)

    return dealt.mapInArrow(run, las.schema_of(what))
