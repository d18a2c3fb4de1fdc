"""Incremental ingestion: the batch operators over streams of points, with tables of files as the static side.

Sinks are tables in a folder, so nothing is gathered on the driver. State is kept by key: patches, files, tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from geolode.operators import grid
from geolode.operators.lod import LOADS
from geolode.sources import las


def read_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files at a path, a few files in each batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def read_las_stream(spark: SparkSession, path: str, what: str, log: str, files_a_batch: int = 1000, **options: object) -> DataFrame:
    """A stream of headers, chunks, chunk_points or points of the LAS files of a growing folder; log is a folder of the stream's own."""
    las.register(spark)
    return spark.readStream.format("las").options(what=what, log=log, files_per_batch=str(files_a_batch), **{k: str(v) for k, v in options.items()}).load(path)


def finish(stream: DataFrame, folder: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None, in_batches: bool = False) -> DataFrame:
    """Runs a stream over what is there now and returns the table that it leaves.

    in_batches is for sources in Python, which Spark would else ask for one batch only. append and update write each batch to a folder of its own, so a batch that runs twice replaces itself; complete replaces the whole.
    """

    def put(batch: DataFrame, number: int) -> None:
        out = each(batch, number) if each else batch
        out.write.mode("overwrite").parquet(f"{folder}/table/batch={0 if mode == 'complete' else number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state").foreachBatch(put)
    if in_batches:
        query = writer.start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()
    else:
        writer.trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/table")


def with_files(points: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Streamed points joined with what is known of their files."""
    return points.join(files, key)


def accumulate(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Running count, sum and bounds by key."""
    return points.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.min(value).alias("low"), F.max(value).alias("high"))


def complete(points: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """Keys (with column expected) of which all points have come."""
    return points.groupBy(key).agg(F.count("*").alias("n")).join(expected, key).filter(F.col("n") >= F.col("expected"))


def held_back(rows: DataFrame, key: str, opens: str, out: str) -> DataFrame:
    """Rows (key, id, kind) of each key, kept back until its first row of kind opens has come; then all of them go on.

    The state of a key is its waiting ids, so it is bounded by what can come before a file's header.
    """

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting, ready = state.get if state.exists else ([], False)
        waiting = list(waiting)
        for part in parts:
            waiting += part["id"].tolist()
            ready = ready or bool((part["kind"] == opens).any())
        if ready and waiting:
            yield pd.DataFrame({key: k[0], "id": waiting})
            waiting = []
        state.update((waiting, ready))

    return rows.groupBy(key).applyInPandasWithState(step, out, "waiting array<bigint>, ready boolean", "append", GroupStateTimeout.NoTimeout)


def prioritised(rows: DataFrame, weight: str, order: list[str], most: int = LOADS) -> DataFrame:
    """The heaviest rows, as a frame's work list."""
    return rows.orderBy(F.desc(weight), *order).limit(most)


def running_top(stream: DataFrame, folder: str, weight: str, order: list[str], most: int = LOADS) -> DataFrame:
    """The heaviest rows of all that has come: each batch is merged with the list that the batch before left.

    A batch writes its list to a folder of its own, so one that runs twice starts from the same list again.
    """

    def put(batch: DataFrame, number: int) -> None:
        if number:
            batch = batch.unionByName(batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/list/batch={number - 1}"))
        prioritised(batch, weight, order, most).write.mode("overwrite").parquet(f"{folder}/list/batch={number}")

    query = stream.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    lists = stream.sparkSession.read.parquet(f"{folder}/list")
    return lists.filter(F.col("batch") == lists.agg(F.max("batch")).first()[0]).drop("batch")


def windowed(events: DataFrame, time: str, late: str, size: str, *keys: str) -> DataFrame:
    """Counts by event-time window, with late rows up to a delay. An extension: the point data has no event time."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count("*").alias("n"))


def arrivals(points: DataFrame) -> DataFrame:
    """px, py, n: how many of the points (px, py) count for each patch, which are its own and those of the eight around it; summed up by task, as patches need no single point."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            own = part.groupby(["px", "py"]).size()
            sent = [own.reset_index(name="n").assign(px=lambda d, dx=dx: d["px"] + dx, py=lambda d, dy=dy: d["py"] + dy) for dx, dy in grid.AROUND]
            yield pd.concat(sent).groupby(["px", "py"], as_index=False)["n"].sum()

    return points.select("px", "py").mapInPandas(run, "px int, py int, n bigint")


def around(expected: DataFrame) -> DataFrame:
    """expected (px, py, expected) as sums over each patch and the eight around it, for the patches that it has."""
    sent = grid.with_neighbours(expected).select(F.col("to_px").alias("px"), F.col("to_py").alias("py"), "expected")
    return expected.select("px", "py").join(sent.groupBy("px", "py").agg(F.sum("expected").alias("expected")), ["px", "py"])


#: Patches along a side of the blocks whose counts are one state.
BLOCK = 32


def completed(points: DataFrame, expected: DataFrame) -> DataFrame:
    """Patches (px, py, n) of a stream of points, each once: in the batch in which the last point of its own or of a patch around it comes.

    expected (px, py, expected) says how many points each patch will get. The state is an array of numbers for a block of patches, as a call for each patch costs far more than its sum.
    """

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = np.array(state.get[0], np.int64) if state.exists else np.zeros(BLOCK * BLOCK, np.int64)
        part = pd.concat(list(parts))
        place = ((part["py"] - key[1] * BLOCK) * BLOCK + part["px"] - key[0] * BLOCK).to_numpy()
        came, wanted = np.zeros_like(n), np.zeros_like(n)
        np.add.at(came, place, part["n"].to_numpy(np.int64))
        wanted[place] = part["expected"]
        waits = n >= 0  # of the others it has been said
        n[waits] += came[waits]
        full = np.unique(place)
        full = full[waits[full] & (n[full] >= wanted[full])]
        if len(full):
            yield pd.DataFrame({"px": key[0] * BLOCK + full % BLOCK, "py": key[1] * BLOCK + full // BLOCK, "n": n[full]})
            n[full] = -1
        state.update((n.tolist(),))

    known = arrivals(points).join(around(expected), ["px", "py"])
    known = known.withColumns({f"b{a}": F.floor(F.col(f"p{a}") / BLOCK).cast("int") for a in "xy"})
    return known.groupBy("bx", "by").applyInPandasWithState(step, "px int, py int, n bigint", "n array<bigint>", "append", GroupStateTimeout.NoTimeout)
