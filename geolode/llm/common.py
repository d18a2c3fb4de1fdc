"""What the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolode.plans.storage import without_clash

#: ASCII white space, between words; as a class for Java's and RE2's regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a table that may be broadcast, at up to this many bytes altogether.
BROADCAST_BYTES = 8 << 20


#: Texts that a Python worker holds as objects at once.
TOGETHER = 256


def few(batches: Iterator[pa.RecordBatch], rows: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, so that a worker's memory doesn't hang on the batch size."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Where none is set on one machine, a temporary one is taken; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master != "local" and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="spark-checkpoints-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """df written once to the shared folder, so that lost executors cost no more than their tasks."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table of Parquet files in the shared folder, read again; for wide rows."""
    path = f"{shared_folder(df.sparkSession)}/tables/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def words(text: Column) -> Column:
    """Array of the words of text, which white space separates; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def small_side(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if rows of row_bytes stay under BROADCAST_BYTES; else as it is, for a shuffle join."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_BYTES else df
