"""Triangles of heightmaps on a picture: a rasteriser in screen bins.

A patch has a vertex at every texel, and those along its far edges belong to the patches after it; heights and colours there come by joins on patch keys. Tasks turn the
patches that they hold into triangles on the picture, deal these to square bins of it, and resolve each bin as a depth buffer in numpy, box pixels in blocks of bounded size. What leaves a
task is at most one row per pixel that it drew, and the nearest of all tasks is a hash aggregate. Triangles are never shuffled, so neither a bin nor a pixel with most
of them is skew, and no row stands for a pixel of a box.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.functions.camera import Camera

#: Pixels of a bin's side, box pixels that are handled at once, patches whose triangles are held at once, and bins that a task holds before it hands them on.
BIN, PIXELS, PATCHES, BINS = 64, 1 << 18, 16, 4096
NONE = np.iinfo(np.int64).max
#: Corners of a square's two triangles, as offsets of its first vertex.
HALVES = (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))


def bordered(maps: DataFrame, side: int = C.TEXELS) -> DataFrame:
    """maps (px, py, height, colour: side x side, one row of y after another; colour may be null) with what the patches after them add: east, north and corner (height, colour)."""
    at = lambda k: F.struct(F.element_at("height", k).alias("height"), F.element_at("colour", k).alias("colour"))
    line = lambda first, step: F.transform(F.sequence(F.lit(first), F.lit(first + step * (side - 1)), F.lit(step)), at)
    whole = maps.select("px", "py", "height", "colour")
    for name, dx, dy, edge in (("east", 1, 0, line(1, side)), ("north", 0, 1, line(1, 1)), ("corner", 1, 1, F.array(at(F.lit(1))))):
        moved = maps.select((F.col("px") - dx).alias("px"), (F.col("py") - dy).alias("py"), edge.alias(name))
        whole = whole.join(moved, ["px", "py"], "left")
    return whole


def vertices(height: np.ndarray, px: int, py: int, camera: Camera, size: float = C.TEXEL) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Picture x, y and depth of the vertices of a patch (heights of side + 1 by side + 1)."""
    n = len(height)
    x, y = np.meshgrid((px * (n - 1) + np.arange(n)) * size, (py * (n - 1) + np.arange(n)) * size)
    m = camera.matrix
    cx, cy, w = (m[k][0] * x + m[k][1] * y + m[k][2] * height + m[k][3] for k in (0, 1, 3))
    with np.errstate(divide="ignore", invalid="ignore"):
        return (cx / w * 0.5 + 0.5) * float(camera.width), (cy / w * 0.5 + 0.5) * float(camera.height), w


def triangles(height: np.ndarray, colour: np.ndarray, px: int, py: int, camera: Camera, mixed: bool = True) -> dict[str, np.ndarray]:
    """Front faces before the camera: corners (n, 3, 3: x, y, depth), their places in the square (n, 3, 2) and the colours around it (n, 4, 3)."""
    n = len(height) - 1
    at = np.stack(vertices(height, px, py, camera), -1)
    near = np.stack([colour[dy : n + dy, dx : n + dx] if mixed else colour[:n, :n] for dy in (0, 1) for dx in (0, 1)], 2).reshape(n * n, 4, 3)
    found = []
    for half in HALVES:
        corners = np.stack([at[dy : n + dy, dx : n + dx] for dx, dy in half], 2).reshape(n * n, 3, 3)
        places = np.broadcast_to(np.array(half, float), (n * n, 3, 2))
        found.append((corners, places, near))
    corners, places, near = (np.concatenate(x) for x in zip(*found, strict=True))
    a, b = corners[:, 1, :2] - corners[:, 0, :2], corners[:, 2, :2] - corners[:, 0, :2]
    with np.errstate(invalid="ignore"):
        front = (corners[:, :, 2] > 0).all(1) & (a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0] > 0)
    return {"corners": corners[front], "places": places[front], "near": near[front]}


class Bins:
    """Depth buffers by bin: depth in thousandths and colour in one integer, the least counts."""

    def __init__(self, camera: Camera) -> None:
        self.width, self.height, self.held = camera.width, camera.height, {}

    def draw(self, corners: np.ndarray, places: np.ndarray, near: np.ndarray) -> None:
        size = np.array([self.width, self.height])
        low = np.floor(np.clip(corners[:, :, :2].min(1), 0, size)).astype(int)
        high = np.ceil(np.clip(corners[:, :, :2].max(1), 0, size)).astype(int)  # exclusive
        seen = np.flatnonzero((high > low).all(1))
        first, last = low[seen] // BIN, (high[seen] - 1) // BIN
        wide = last - first + 1
        # a pair for each bin that a triangle's box meets
        pair = np.repeat(seen, wide.prod(1))
        k = np.arange(len(pair)) - np.repeat(np.cumsum(wide.prod(1)) - wide.prod(1), wide.prod(1))
        across = np.repeat(wide[:, 0], wide.prod(1))
        at = np.repeat(first, wide.prod(1), axis=0) + np.column_stack([k % across, k // across])
        order = np.lexsort((at[:, 0], at[:, 1]))
        pair, at = pair[order], at[order]
        cuts = np.flatnonzero((np.diff(at, axis=0) != 0).any(1)) + 1
        for part, where in zip(np.split(pair, cuts), np.split(at, cuts), strict=True):
            if len(part):
                self._resolve(tuple(where[0]), part, low, high, corners, places, near)

    def _resolve(self, where: tuple[int, int], part: np.ndarray, low: np.ndarray, high: np.ndarray, corners: np.ndarray, places: np.ndarray, near: np.ndarray) -> None:
        buffer = self.held.setdefault(where, np.full(BIN * BIN, NONE))
        edge = np.array(where) * BIN
        begin, end = np.maximum(low[part], edge), np.minimum(high[part], edge + BIN)
        count = (end - begin).prod(1)
        for some in np.split(np.arange(len(part)), np.flatnonzero(np.diff(np.cumsum(count) // PIXELS)) + 1):
            n = count[some]
            t = np.repeat(some, n)
            k = np.arange(len(t)) - np.repeat(np.cumsum(n) - n, n)
            span = (end - begin)[t, 0]
            ix, iy = begin[t, 0] + k % span, begin[t, 1] + k // span
            f = part[t]
            (x0, y0, w0), (x1, y1, w1), (x2, y2, w2) = (corners[f, c].T for c in range(3))
            qx, qy, ax, ay, bx, by = ix - x0, iy - y0, x1 - x0, y1 - y0, x2 - x0, y2 - y0
            whole = ax * by - ay * bx
            s, u = (qx * by - qy * bx) / whole, (ax * qy - ay * qx) / whole
            v = 1.0 - (s + u)
            inside = np.flatnonzero((s >= 0) & (u >= 0) & (v >= 0))
            depth = np.round((v * w0 + s * w1 + u * w2)[inside] * 1.2 + 10.0, 3)
            s, u, v, f = s[inside, None], u[inside, None], v[inside, None], f[inside]
            place = v * places[f, 0] + s * places[f, 1] + u * places[f, 2]
            px, py = place[:, :1], place[:, 1:]
            mixed = near[f, 0] * ((1 - px) * (1 - py)) + near[f, 1] * (px * (1 - py)) + near[f, 2] * ((1 - px) * py) + near[f, 3] * (px * py)
            rgb = np.floor(mixed + 1e-9).astype(np.int64)
            packed = np.round(depth * 1000).astype(np.int64) * C.U32 + rgb[:, 0] + 256 * rgb[:, 1] + 65536 * rgb[:, 2]
            if (depth >= 2_147_483).any():
                raise ValueError("a fragment's depth is beyond 2147483")
            np.minimum.at(buffer, (iy[inside] - edge[1]) * BIN + ix[inside] - edge[0], packed)

    def rows(self) -> Iterator[pa.RecordBatch]:
        """Pixels that were drawn, and the bins are empty again."""
        for (bx, by), buffer in self.held.items():
            at = np.flatnonzero(buffer != NONE)
            if len(at):
                columns = [bx * BIN + at % BIN, by * BIN + at // BIN, (buffer[at] // C.U32) / 1000.0, buffer[at] % C.U32]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], ["ix", "iy", "depth", "colour"])
        self.held = {}


def _plane(own: np.ndarray, east: np.ndarray, north: np.ndarray, corner: np.ndarray, side: int) -> np.ndarray:
    out = np.zeros((side + 1, side + 1))
    out[:side, :side], out[:side, side], out[side, :side], out[side, side] = own.reshape(side, side), east, north, corner
    return out


def patch_planes(row: dict, side: int) -> tuple[np.ndarray, np.ndarray]:
    """Heights and colours (red, green, blue) of a bordered row's vertices; 0 where there is no patch or no texel."""

    def values(cells: list[dict] | None, name: str, n: int) -> np.ndarray:
        return np.array([(c[name] or 0) if c else 0 for c in cells], float) if cells else np.zeros(n)

    edges = [(row[e], n) for e, n in (("east", side), ("north", side), ("corner", 1))]
    own = lambda name: np.array([v or 0 for v in row[name] or [0] * side * side], float)
    height = _plane(own("height"), *[values(e, "height", n) for e, n in edges], side)
    packed = _plane(own("colour"), *[values(e, "colour", n) for e, n in edges], side).astype(np.int64)
    return height, np.stack([packed % 256, packed // 256 % 256, packed // 65536 % 256], -1).astype(float)


def fragments(maps: DataFrame, camera: Camera, side: int = C.TEXELS, mixed: bool = True) -> DataFrame:
    """ix, iy, depth and colour (red + 256 green + 65536 blue) of the pixels that each task draws of maps (px, py, height, colour); ``aggregate.depth_buffer`` takes the nearest.

    A colour is mixed of the four texels around its place, or without mixed that of its square's first texel. A null height or colour, and those of missing patches, are 0. A map without rows gives no pixel.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = Bins(camera)
        for batch in batches:
            for at in range(0, batch.num_rows, PATCHES):
                found = [triangles(*patch_planes(row, side), row["px"], row["py"], camera, mixed) for row in batch.slice(at, PATCHES).to_pylist()]
                bins.draw(*[np.concatenate([t[k] for t in found]) for k in ("corners", "places", "near")])
                if len(bins.held) > BINS:
                    yield from bins.rows()
        yield from bins.rows()

    dealt = bordered(maps, side)
    parts = int(maps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.withColumn("deal", F.xxhash64("px", "py")).repartition(parts, "deal").drop("deal").mapInArrow(run, "ix int, iy int, depth double, colour bigint")


def as_maps(texels: DataFrame, value: str, kind: str, side: int = C.TEXELS) -> DataFrame:
    """px, py and value as an array of side x side (null where there is none) from rows px, py, tx, ty, value; a patch has so many at most."""
    entries = F.map_from_entries(F.collect_list(F.struct((F.col("ty") * side + F.col("tx")).cast("int").alias("k"), F.col(value).cast(kind).alias("v"))))
    grouped = texels.groupBy("px", "py").agg(entries.alias("cells"))
    return grouped.select("px", "py", F.transform(F.sequence(F.lit(0), F.lit(side * side - 1)), lambda k: F.col("cells")[k]).alias(value))
