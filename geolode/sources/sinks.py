"""Writers: texts are composed by expressions; binary products become rows of path and content for the ``files`` sink."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.functions import columns as C

#: Meshes of a batch of results, and types of their columns; blocks of heights of a batch of files.
MESHES, ARROW = 32, {"int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
BLOCKS = 8


def point_line(decimals: int = 1, alpha: int = 255) -> Column:
    """x, y, z, r, g, b, alpha as text."""
    return F.concat_ws(", ", *[F.format_string(f"%.{decimals}f", a) for a in "xyz"], *[F.col(a).cast("string") for a in "rgb"], F.lit(str(alpha)))


def tile_report(points: DataFrame, tiles: DataFrame, every: int = 50_000) -> DataFrame:
    """tile_id and a line: bounds and every so many-th point with two decimals, in order."""
    number = lambda a: F.format_string("%.2f", a)
    some = points.filter(F.pmod("point_idx", F.lit(every)) == 0).select("tile_id", F.struct("point_idx", F.concat_ws(" ", *[number(a) for a in "xyz"]).alias("t")).alias("p"))
    listed = some.groupBy("tile_id").agg(F.array_join(F.sort_array(F.collect_list("p"))["t"], ", ").alias("sample"))
    bounds = F.concat_ws(" ", *[number(f"{n}_{a}") for n in ("min", "max") for a in "xyz"])
    return tiles.join(listed, "tile_id").select("tile_id", F.concat_ws("; ", bounds, "sample").alias("line"))


def xyzrgba(points: DataFrame, tiles: DataFrame) -> DataFrame:
    """path and content of a binary file per tile: a head of zeros and the size, then x, y, z and colour of each point from the tile's corner on."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("point_idx")
        low, high = (part[[f"{n}_{a}" for a in "xyz"]].iloc[0].to_numpy(float) for n in ("min", "max"))
        rows = np.zeros(len(part), [("p", "<f4", 3), ("c", "u1", 4)])
        rows["p"] = part[["x", "y", "z"]].to_numpy() - low
        rows["c"] = np.column_stack([part[["r", "g", "b"]].to_numpy(), np.full(len(part), 255)])
        return pd.DataFrame([(f"tile_{part['tile_id'].iloc[0]}.bin", struct.pack("<6f", 0, 0, 0, *(high - low)) + rows.tobytes())], columns=["path", "content"])

    return points.select("tile_id", "point_idx", *"xyzrgb").join(tiles.drop("n_points"), "tile_id").groupBy("tile_id").applyInPandas(one, "path string, content binary")


def read_xyzrgba(files: DataFrame) -> DataFrame:
    """path, n, x, y, z (from the tile's corner on), r, g, b and a of the files that xyzrgba() makes."""

    def run(parts):
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                rows = np.frombuffer(content, [("p", "<f4", 3), ("c", "u1", 4)], offset=24)
                yield pd.DataFrame({"path": path, "n": np.arange(len(rows)), **{a: rows["p"][:, k] for k, a in enumerate("xyz")}, **{a: rows["c"][:, k].astype(np.int32) for k, a in enumerate("rgba")}})

    return files.mapInPandas(run, "path string, n bigint, x float, y float, z float, r int, g int, b int, a int")


def height_files(heights: DataFrame, size: int = 64) -> DataFrame:
    """path and content of a 16-bit PPM and a float raster for each size x size block of a height raster (ix, iy, height).

    Cells are dealt over all shuffle partitions: coalesced by size, a task would sort more of them, as their rows are short. They are sorted by one number, which needs no rows compared.
    """
    from geolode.operators.heightmap import whole_patches

    head, kinds = b"P6 %d %d 65535\n" % (size, size), pa.schema([("path", pa.string()), ("content", pa.binary())])

    def placed(batch: pa.RecordBatch) -> pa.RecordBatch:
        ix, iy, height = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        return pa.RecordBatch.from_arrays([pa.array(v) for v in (ix // size, iy // size, iy % size * size + ix % size, height)], ["px", "py", "texel", "height"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begin in whole_patches(map(placed, batches)):
            for low in range(0, len(begin) - 1, BLOCKS):
                cuts = begin[low : low + BLOCKS + 1]
                part = slice(cuts[0], cuts[-1])
                h = np.zeros((len(cuts) - 1, size * size), np.float32)
                h[np.repeat(np.arange(len(h)), np.diff(cuts)), rows["texel"][part]] = rows["height"][part]
                grey = np.repeat(np.clip(h * 10, 0, 65535).astype(">u2"), 3, 1)
                paths = [f"{int(rows['px'][k])}_{int(rows['py'][k])}.{kind}" for k in cuts[:-1] for kind in ("ppm", "heightmap")]
                contents = [content for g, f in zip(grey, h, strict=True) for content in (head + g.tobytes(), f.tobytes())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip((paths, contents), kinds, strict=True)], schema=kinds)

    px, py = (C.cell(F.col(f"i{a}"), float(size)) for a in "xy")
    parts = int(heights.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = heights.select("ix", "iy", "height").repartition(parts, px, py).sortWithinPartitions(px * F.lit(C.U32) + py)
    return dealt.mapInArrow(run, "path string, content binary")


def read_height_files(files: DataFrame, size: int = 64, above: float | None = None) -> DataFrame:
    """ix, iy, height and grey of the files that height_files() makes, both of a block together; with above, of the higher pixels only."""

    def one(part: pa.Table) -> pa.Table:
        paths = part["path"].to_pylist()
        content = dict(zip([p.rsplit(".", 1)[1] for p in paths], part["content"].to_pylist(), strict=True))
        bx, by = map(int, paths[0].split(".", 1)[0].split("_"))
        height, grey = np.frombuffer(content["heightmap"], "<f4"), np.frombuffer(content["ppm"][-6 * size * size :], ">u2")[::3]
        at = np.arange(size * size) if above is None else np.flatnonzero(height > above)
        y, x = np.divmod(at, size)
        ix, iy, grey = (v.astype(np.int32) for v in (x + bx * size, y + by * size, grey[at]))
        return pa.Table.from_arrays([pa.array(ix), pa.array(iy), pa.array(height[at], from_pandas=True), pa.array(grey)], ["ix", "iy", "height", "grey"])

    block = F.substring_index("path", ".", 1)
    return files.select("path", "content").groupBy(block).applyInArrow(one, "ix int, iy int, height float, grey int")


def pictures(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """path and content of a PNG for each path of pixels (path, ix, iy, r, g, b: one row a pixel, so a group is as large as a picture)."""

    def one(part: pd.DataFrame) -> pd.DataFrame:
        picture = np.zeros((height, width, 3))
        picture[part["iy"], part["ix"]] = part[["r", "g", "b"]].to_numpy() / 255 + 1e-9
        return pd.DataFrame([(part["path"].iloc[0], png(picture))], columns=["path", "content"])

    return pixels.groupBy("path").applyInPandas(one, "path string, content binary")


def read_png(files: DataFrame) -> DataFrame:
    """path, ix, iy, r, g, b of PNG files as png() makes them (8-bit colours, rows without a filter)."""

    def run(parts):
        for part in parts:
            for path, content in zip(part["path"], part["content"], strict=True):
                width, height = struct.unpack_from(">II", content, 16)
                at, data = 8, b""
                while at < len(content):
                    n, kind = struct.unpack_from(">I4s", content, at)
                    data += content[at + 8 : at + 8 + n] if kind == b"IDAT" else b""
                    at += n + 12
                rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(height, 1 + 3 * width)[:, 1:].reshape(-1, 3).astype(np.int32)
                y, x = np.divmod(np.arange(width * height), width)
                yield pd.DataFrame({"path": path, "ix": x, "iy": y, **{a: rows[:, k] for k, a in enumerate("rgb")}})

    return files.mapInPandas(run, "path string, ix bigint, iy bigint, r int, g int, b int")


def png(picture: np.ndarray) -> bytes:
    """An 8-bit PNG of values 0 to 1 (height x width x 3), which are cut, not rounded."""
    rows = (picture * 255).astype(np.uint8)
    raw = b"".join(b"\0" + r.tobytes() for r in rows)

    def part(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1], rows.shape[0], 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(raw)) + part(b"IEND", b"")


def stl(vertices: np.ndarray, faces: np.ndarray) -> bytes:
    """A binary STL of faces over vertices (n x 3)."""
    t = vertices[faces].astype("<f4")
    normal = np.cross(t[:, 1] - t[:, 0], t[:, 2] - t[:, 0])
    normal /= np.maximum(np.linalg.norm(normal, axis=1, keepdims=True), 1e-30)
    rows = np.zeros(len(t), [("v", "<f4", (4, 3)), ("k", "<u2")])
    rows["v"][:, 0], rows["v"][:, 1:] = normal, t
    return bytes(80) + struct.pack("<I", len(t)) + rows.tobytes()


def off(vertices: np.ndarray, faces: np.ndarray) -> str:
    lines = ["OFF", f"{len(vertices)} {len(faces)} 0", *[" ".join(f"{v:g}" for v in p) for p in vertices], *[f"3 {a} {b} {c}" for a, b, c in faces]]
    return "\n".join(lines) + "\n"


def _meshes(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """px, py, distinct samples in order of lx, ly (the lowest of equal places) and their faces, of rows sorted by patch; the patches of a batch are triangulated in step."""
    from geolode.operators.heightmap import triangulate_all, whole_patches

    for rows, begin in whole_patches(batches):
        part = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        order = np.lexsort((rows["lz"], rows["ly"], rows["lx"], part))
        p = np.column_stack([rows[f"l{a}"][order] for a in "xyz"])
        new = np.ones(len(p), bool)
        new[1:] = (part[1:] != part[:-1]) | (p[1:, :2] != p[:-1, :2]).any(1)
        p, ends = p[new], np.searchsorted(part[new], np.arange(len(begin)))
        each = [p[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        centred = [q[:, :2] - q[:, :2].mean(0) for q in each]
        owners, found = triangulate_all(np.concatenate([q / max(np.abs(q).max(), 1e-9) for q in centred]), [len(q) for q in each])
        faces = np.split(found, np.searchsorted(owners, np.arange(1, len(each))))
        yield from zip(rows["px"][begin[:-1]].tolist(), rows["py"][begin[:-1]].tolist(), each, faces, strict=True)


def _of_meshes(context: DataFrame, make: Callable[[int, int, np.ndarray, np.ndarray], tuple], schema: str) -> DataFrame:
    """A row for each patch of context (px, py, lx, ly, lz), made of its px, py, vertices and faces."""
    from geolode.operators.heightmap import by_patch

    context = context.select("px", "py", "lx", "ly", "lz")
    kinds = pa.schema([(n, ARROW[t]) for n, t in (f.split() for f in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (make(*mesh) for mesh in _meshes(batches))
        while some := list(islice(found, MESHES)):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*some, strict=True), kinds, strict=True)], schema=kinds)

    return by_patch(context, ["lx", "ly", "lz"]).mapInArrow(run, schema)


def mesh_files(context: DataFrame) -> DataFrame:
    """path and content of an STL for each patch of context (px, py, lx, ly, lz)."""
    return _of_meshes(context, lambda px, py, p, faces: (f"{px}_{py}.stl", stl(p, faces)), "path string, content binary")


def off_files(context: DataFrame) -> DataFrame:
    """px, py and content of an OFF for each patch of context (px, py, lx, ly, lz)."""
    return _of_meshes(context, lambda px, py, p, faces: (px, py, off(p, faces)), "px int, py int, content string")
