"""Rasters: points, lines and triangles become fragments, which a depth buffer resolves."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.functions.camera import Camera

#: Corners of a box by bit and the pairs of corners that its edges join.
EDGES = [(a, b) for a in range(8) for b in range(8) if a < b and (a ^ b) in (1, 2, 4)]
#: Triangles of a box, two for each side.
SIDES = [(0, 1, 3, 2), (4, 5, 7, 6), (0, 1, 5, 4), (2, 3, 7, 6), (0, 2, 6, 4), (1, 3, 7, 5)]


def _once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with columns that are computed once for each row.

    A filter on projected columns is pushed below the projection, which repeats its long expressions in every comparison; it
    stays above a generator, here of a single row.
    """
    one = F.inline(F.array(F.struct(*[v.alias(k) for k, v in columns.items()])))
    return df.select("*", one)


def point_fragments(points: DataFrame, camera: Camera, colour: Column) -> DataFrame:
    """Fragments ix, iy, depth, colour of the points that the picture shows; depth is rounded to a thousandth."""
    names = [c for c in "rgb" if c in points.columns]
    at = _once(points.select(*"xyz", colour.alias("colour"), *names), dict(zip(("fx", "fy", "w"), camera.screen(F.col("x"), F.col("y"), F.col("z")), strict=True))).select("fx", "fy", "w", "colour", *names)
    shown = at.filter(camera.in_picture(F.col("fx"), F.col("fy"), F.col("w")))
    return shown.withColumns({"ix": F.floor("fx").cast("int"), "iy": F.floor("fy").cast("int"), "depth": F.round("w", 3)}).drop("fx", "fy", "w")


def corner(low: list[Column], high: list[Column], k: int) -> list[Column]:
    return [(high if k >> d & 1 else low)[d] for d in range(3)]


def box_edges(boxes: DataFrame, low: list[Column], high: list[Column]) -> DataFrame:
    """boxes, repeated for their twelve edges: edge, ax, ay, az, bx, by, bz."""
    names = ("ax", "ay", "az", "bx", "by", "bz")
    edges = [F.struct(F.lit(n).alias("edge"), *[c.alias(m) for c, m in zip([*corner(low, high, a), *corner(low, high, b)], names, strict=True)]) for n, (a, b) in enumerate(EDGES)]
    return boxes.withColumn("__e", F.explode(F.array(*edges))).select("*", "__e.*").drop("__e")


def box_triangles(boxes: DataFrame, low: list[Column], high: list[Column]) -> DataFrame:
    """boxes, repeated for their twelve triangles: triangle and its corners x0 to z2."""
    triangles = [t for a, b, c, d in SIDES for t in ((a, b, c), (a, c, d))]
    structs = [F.struct(F.lit(n).alias("triangle"), *[c.alias(f"{axis}{v}") for v, k in enumerate(t) for axis, c in zip("xyz", corner(low, high, k), strict=True)]) for n, t in enumerate(triangles)]
    return boxes.withColumn("__t", F.explode(F.array(*structs))).select("*", "__t.*").drop("__t")


def line_fragments(lines: DataFrame, camera: Camera, most: int = 400) -> DataFrame:
    """Fragments of lines (ax to bz, colour): at most so many steps, depth linear along the line; lines that reach behind the camera are left out."""
    a, b = camera.screen(F.col("ax"), F.col("ay"), F.col("az")), camera.screen(F.col("bx"), F.col("by"), F.col("bz"))
    ends = lines.select("colour", *[c.alias(f"{p}{n}") for p, e in (("a", a), ("b", b)) for n, c in zip("xyw", e, strict=True)]).filter("aw > 0 AND bw > 0")
    steps = F.least(F.lit(most), F.greatest(F.lit(1), F.ceil(F.greatest(F.abs(F.col("bx") - F.col("ax")), F.abs(F.col("by") - F.col("ay"))))).cast("int"))
    at = ends.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps"))))
    u = F.col("k") / F.col("steps")
    fx, fy, w = (C.lerp(F.col(f"a{n}"), F.col(f"b{n}"), u) for n in "xyw")
    at = at.select("colour", fx.alias("fx"), fy.alias("fy"), w.alias("w")).filter(camera.in_picture(F.col("fx"), F.col("fy"), F.col("w")))
    return at.select(F.floor("fx").cast("int").alias("ix"), F.floor("fy").cast("int").alias("iy"), F.round("w", 3).alias("depth"), "colour")


def highest(points: DataFrame, size: float = 10.0) -> DataFrame:
    """Greatest z by pixel; heights below 0 count as 0."""
    return points.groupBy(C.cell(F.col("lx"), size).alias("ix"), C.cell(F.col("ly"), size).alias("iy")).agg(F.greatest(F.max("z"), F.lit(0.0)).alias("height"))


#: Cells along a side of the blocks in which a raster's cells meet their neighbours.
BLOCK = 64


def steps(cells: DataFrame) -> DataFrame:
    """ix, iy, dx and dy of the cells (ix, iy, h; one row each) that have all four sides: the height to the right less that to the left, and above less below.

    Blocks of cells are dealt out, each with the line of cells around it, so next to all cells are shuffled once, as one row; sides are then rows before and after.
    A cell around a block lacks a side there, so only the block that it is in gives it.
    """
    at = cells.select("ix", "iy", "h")
    for a in "xy":
        low, high = (C.cell(F.col(f"i{a}") + d, float(BLOCK)) for d in (-1, 1))
        at = at.withColumn(f"b{a}", F.explode(F.sequence(low, high)))
    at = at.repartition("bx", "by")
    for a, b in ("xy", "yx"):
        line, i = Window.partitionBy("bx", "by", f"i{b}").orderBy(f"i{a}"), F.col(f"i{a}")
        both = (F.lag(i).over(line) == i - 1) & (F.lead(i).over(line) == i + 1)
        at = at.withColumns({f"d{a}": F.lead("h").over(line) - F.lag("h").over(line), f"has_{a}": both})
    return at.filter("has_x AND has_y").select("ix", "iy", "dx", "dy")


#: Pairs of samples and offsets that a task splats at once.
PAIRS = 1 << 20


def rounded(values: np.ndarray, decimals: int = 6) -> np.ndarray:
    """values to so many decimals, halves away from 0; in the task, as ``F.round`` makes a decimal of each."""
    return np.copysign(np.floor(np.abs(values) * 10.0**decimals + 0.5) / 10.0**decimals, values)


def splat(samples: DataFrame, keys: list[str], size: int, radius: int = 10) -> DataFrame:
    """Heights of a size x size raster as weighted means of the samples (ix, iy, h) within the radius, by keys.

    The weight falls with the distance and is none from the radius on. Samples alone are shuffled: the task that has a raster's samples adds them up there,
    some at a time, so no row stands for a sample and an offset.
    """
    offsets = [(dx, dy, 1.0 - math.exp(-(1.0 - (dx * dx + dy * dy) ** 0.5 / radius) / (radius + 0.1))) for dx in range(-radius, radius + 1) for dy in range(-radius, radius + 1) if dx * dx + dy * dy < radius * radius]
    dx, dy = (np.array([o[k] for o in offsets]) for k in range(2))
    w = np.array([o[2] for o in offsets])
    names = [*keys, "ix", "iy", "h", "n"]
    schema = ", ".join([*[f"`{k}` {samples.schema[k].dataType.simpleString()}" for k in keys], "ix int, iy int, h double, n bigint"])

    def done(key: tuple, kinds: list[pa.DataType], sums: np.ndarray, count: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(count)
        columns = [*[pa.array([k], t).take(pa.array(np.zeros(len(at), np.int64))) for k, t in zip(key, kinds, strict=True)], pa.array(at % size, pa.int32()), pa.array(at // size, pa.int32()), pa.array(rounded(sums[0, at] / sums[1, at])), pa.array(count[at], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kinds, sums, count = None, None, None, None
        for batch in batches:
            kinds = batch.schema.types[: len(keys)]
            ix, iy, h = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False) for n in ("ix", "iy", "h"))
            heads = list(zip(*[batch.column(k).to_pylist() for k in range(len(keys))], strict=True))
            cuts = [0, *[k for k in range(1, len(heads)) if heads[k] != heads[k - 1]], len(heads)]
            for low, high in zip(cuts, cuts[1:], strict=False):
                if low == high:
                    continue
                if key != heads[low]:
                    if key is not None:
                        yield done(key, kinds, sums, count)
                    key, sums, count = heads[low], np.zeros((2, size * size)), np.zeros(size * size, np.int64)
                for first in range(low, high, max(1, PAIRS // len(w))):
                    part = slice(first, min(high, first + max(1, PAIRS // len(w))))
                    x, y = ix[part, None] + dx, iy[part, None] + dy
                    inside = (x >= 0) & (x < size) & (y >= 0) & (y < size)
                    at = (y * size + x)[inside]
                    each = np.broadcast_to(w, x.shape)[inside]
                    sums[0] += np.bincount(at, (h[part, None] * w)[inside], size * size)
                    sums[1] += np.bincount(at, each, size * size)
                    count += np.bincount(at, minlength=size * size)
        if key is not None:
            yield done(key, kinds, sums, count)

    parts = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = samples.select(*keys, "ix", "iy", "h").filter("ix IS NOT NULL AND iy IS NOT NULL AND h IS NOT NULL").withColumn("deal", F.xxhash64(*keys)).repartition(parts, "deal").drop("deal").sortWithinPartitions(*keys)
    return dealt.mapInArrow(run, schema)


def grid_mesh(cells: DataFrame, side: int = 64) -> DataFrame:
    """cells, repeated for the two triangles of each square of a side x side grid: gx, gy, half and corners u0, v0 to u2, v2."""
    squares = cells.withColumn("gx", F.explode(F.sequence(F.lit(0), F.lit(side - 1)))).withColumn("gy", F.explode(F.sequence(F.lit(0), F.lit(side - 1))))
    u, v, one = F.col("gx"), F.col("gy"), F.lit(1)
    halves = [((u, v), (u + one, v), (u + one, v + one)), ((u, v), (u + one, v + one), (u, v + one))]
    struct = [F.struct(F.lit(n).alias("half"), *[(c / float(side)).alias(f"{a}{k}") for k, p in enumerate(t) for a, c in zip("uv", p, strict=True)]) for n, t in enumerate(halves)]
    return squares.withColumn("__t", F.explode(F.array(*struct))).select("*", "__t.*").drop("__t")
