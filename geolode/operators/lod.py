"""Level of detail: what a view shows, loads and unloads."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.functions.camera import Camera

EMPTY, LOADING, LOADED, UNLOADING = range(4)
HIGHLY_VISIBLE, LOADS, SUSPICIOUS_HEIGHT = 10_000.0, 100, 8000.0


@dataclass(frozen=True)
class QueryParams:
    """What a view query may switch off or force."""

    show_heightmaps: bool = True
    show_points: bool = True
    force_both: bool = False
    margin: float = 150.0
    patch_size: float = 640.0
    meters_per_pixel: float = 10.0


def next_state(state: Column, visible: Column) -> Column:
    """State of a chunk after a frame: visible ones are loaded, others unloaded, and running work ends."""
    return (
        F.when((state == EMPTY) & visible, LOADING)
        .when(state == LOADING, LOADED)
        .when((state == LOADED) & ~visible, UNLOADING)
        .when(state == UNLOADING, EMPTY)
        .otherwise(state)
    )


def actions(before: Column, after: Column) -> Column:
    """READ for chunks that start to load, UNLOAD for those that start to go, else null."""
    return F.when((before != LOADING) & (after == LOADING), "READ").when((before != UNLOADING) & (after == UNLOADING), "UNLOAD")


def weigh_tiles(tiles: DataFrame, camera: Camera) -> DataFrame:
    """tiles (bounds, n_points) with visible, weight and is_highly_visible."""
    low, high = ([F.col(f"{n}_{a}") for a in "xyz"] for n in ("min", "max"))
    df = tiles.withColumn("visible", camera.sees_box(low, high))
    df = df.withColumn("weight", F.when(F.col("visible"), F.round(camera.tile_weight(low, high, F.col("n_points")), 6)).otherwise(0.0))
    return df.withColumn("is_highly_visible", F.col("weight") > HIGHLY_VISIBLE)


def routes(patches: DataFrame, camera: Camera, params: QueryParams = QueryParams()) -> DataFrame:
    """patches (px, py, has_heightmap) in view with as_points and as_triangles."""
    low = [F.col(p) * params.patch_size - params.margin for p in ("px", "py")]
    high = [(F.col(p) + 1) * params.patch_size + params.margin for p in ("px", "py")]
    seen = patches.filter(camera.sees_box([*low, F.lit(0.0)], [*high, F.lit(0.0)], flat=True))
    if params.force_both:
        return seen.withColumns({"as_points": F.lit(True), "as_triangles": F.col("has_heightmap")})
    triangles = F.col("has_heightmap") & F.lit(params.show_heightmaps)
    return seen.withColumns({"as_points": ~triangles & F.lit(params.show_points), "as_triangles": triangles})


def load_list(chunks: DataFrame, most: int = LOADS) -> DataFrame:
    """The chunks to load next: the heaviest empty ones of visible tiles."""
    return chunks.filter((F.col("state") == EMPTY) & F.col("visible")).orderBy(F.desc("weight"), "tile_id", "chunk_idx").limit(most)
