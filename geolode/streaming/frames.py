"""Views over frames: a stream of cameras, and what every frame does to the chunks.

A camera is a row (frame, yaw, pitch, radius, target_x, target_y, target_z). Its frustum becomes columns, so the tiles that each frame sees are one plan over
frames and tiles. The states of chunks are kept between frames by blocks of tiles, with the number of each tile's last frame, so frames that come again (after a restart)
change nothing. A tile gets a row a frame, as chunks that load or unload go on whether they are seen or not.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from geolode.functions.camera import Camera
from geolode.operators.lod import EMPTY, LOADED, LOADING, UNLOADING

CAMERA = ("yaw", "pitch", "radius", "target_x", "target_y", "target_z")
BEFORE = np.iinfo(np.int64).min
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def planes(frames: DataFrame, camera: Camera) -> DataFrame:
    """frames with the six planes of each one's frustum, planes (a, b, c and d of each, one after another); camera gives the picture and the lens."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            views = [replace(camera, yaw=r.yaw, pitch=r.pitch, radius=r.radius, target=(r.target_x, r.target_y, r.target_z)) for r in part.itertuples()]
            yield pd.DataFrame({"frame": part["frame"], "planes": [v.planes.ravel().tolist() for v in views]})

    return frames.select("frame", *CAMERA).mapInPandas(run, "frame bigint, planes array<double>")


def sees_box(low: list[Column], high: list[Column]) -> Column:
    """Whether a box is inside each of the planes, as ``Camera.sees_box`` says it for one camera."""
    seen = F.lit(True)
    for k in range(6):
        a = [F.col("planes")[4 * k + d] for d in range(4)]
        terms = [a[d] * F.when(a[d] > 0, high[d]).otherwise(low[d]) for d in range(3)]
        seen = seen & (terms[0] + terms[1] + terms[2] + a[3] >= 0)
    return seen


def visible(frames: DataFrame, tiles: DataFrame, camera: Camera) -> DataFrame:
    """tiles (bounds and others) of every frame with visible; there are as many rows as frames times tiles, which is what is asked for."""
    low, high = ([F.col(f"{n}_{a}") for a in "xyz"] for n in ("min", "max"))
    # the frames of a batch are few, whatever the tiles
    return F.broadcast(planes(frames, camera)).crossJoin(tiles).withColumn("visible", sees_box(low, high)).drop("planes")


#: Blocks of tiles whose states are kept together: a fixed number, so that a tile stays in its block.
BLOCKS = 256


def after_frame(states: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """``lod.next_state`` for the states of chunks, with whether each one's tile is seen."""
    out = states.copy()
    out[states == LOADING], out[states == UNLOADING] = LOADED, EMPTY
    out[(states == EMPTY) & seen], out[(states == LOADED) & ~seen] = LOADING, UNLOADING
    return out


class ChunkStates(StatefulProcessor):
    """By block of tiles: rows (tile_id, frame, first: states of the tile's chunks before any frame, visible) in; tile_id, frame, chunk_idx and action (READ or UNLOAD) out."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("chunks", "tiles array<bigint>, frames array<bigint>, sizes array<int>, states array<int>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        part = pd.concat(list(rows)).sort_values("frame", kind="stable")
        tiles, last, sizes, states = (np.array(v, t) for v, t in zip(self.known.get() if self.known.exists() else ([],) * 4, (np.int64, np.int64, np.int64, np.int32), strict=True))
        new = part[~part["tile_id"].isin(tiles)].drop_duplicates("tile_id")
        tiles, last = np.concatenate([tiles, new["tile_id"].to_numpy(np.int64)]), np.concatenate([last, np.full(len(new), BEFORE)])
        sizes, states = np.concatenate([sizes, new["first"].map(len).to_numpy(np.int64)]), np.concatenate([states, *[np.array(f, np.int32) for f in new["first"]]])
        owner, chunk = np.repeat(np.arange(len(tiles)), sizes), np.arange(len(states)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        by_id = np.argsort(tiles)
        found = []
        for frame, some in part.groupby("frame"):
            some = some.drop_duplicates("tile_id")
            at = by_id[np.searchsorted(tiles[by_id], some["tile_id"].to_numpy())]
            moves, seen = np.zeros(len(tiles), bool), np.zeros(len(tiles), bool)
            moves[at], seen[at] = last[at] < frame, some["visible"].to_numpy(bool)
            last[moves] = frame
            after = np.where(moves[owner], after_frame(states, seen[owner]), states)
            for state, action in ((LOADING, "READ"), (UNLOADING, "UNLOAD")):
                which = np.flatnonzero((states != state) & (after == state))
                found.append(pd.DataFrame({"tile_id": tiles[owner[which]], "frame": frame, "chunk_idx": chunk[which], "action": action}))
            states = after
        self.known.update((tiles.tolist(), last.tolist(), sizes.tolist(), states.tolist()))
        yield pd.concat(found)

    def close(self) -> None:
        """Nothing is held open."""


def actions(frames: DataFrame, tiles: DataFrame, camera: Camera, first: Column) -> DataFrame:
    """What a stream of frames has to read and to unload: tile_id, frame, chunk_idx, action; first are the states of a tile's chunks before."""
    rows = visible(frames, tiles, camera).select("tile_id", "frame", first.alias("first"), "visible")
    return rows.withColumn("block", F.pmod(F.xxhash64("tile_id"), F.lit(BLOCKS))).groupBy("block").transformWithStateInPandas(ChunkStates(), "tile_id bigint, frame bigint, chunk_idx bigint, action string", "append", "None")


def with_store(spark: SparkSession) -> None:
    """Sets the store that states of this kind need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
