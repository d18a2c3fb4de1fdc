"""Triangulation, interpolation and meshes."""

import numpy as np
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import heightmap
from geolode.plans.joins import _CONTEXT, contexts, patches
from geolode.plans.registry import number, query

c = F.col


_DISTINCT = "SELECT px, py, count(*) AS n FROM (SELECT DISTINCT px, py, lx, ly FROM ctx) q GROUP BY px, py"


@query("geo_delaunay", f"{_CONTEXT};; SELECT px, py, 2 * n + 2 AS faces FROM ({_DISTINCT}) q")
def geo_delaunay(t):
    """A triangulation of n points in a convex hull of four padding corners has 2 n + 2 faces."""
    return heightmap.faces(contexts(t)).groupBy("px", "py").agg(F.count("*").alias("faces"))


@query("geo_pad", f"{_CONTEXT};; SELECT px, py, n, n + 4 AS padded FROM ({_DISTINCT}) q")
def geo_pad(t):
    found = heightmap.faces(contexts(t)).select("px", "py", F.explode(F.array("v0", "v1", "v2")).alias("v")).groupBy("px", "py").agg(F.count_distinct("v").alias("padded"))
    return found.select("px", "py", (c("padded") - 4).alias("n"), "padded")


@query("geo_mask_pad")
def geo_mask_pad(t):
    return heightmap.faces(contexts(t)).groupBy("px", "py").agg(F.sum(c("padded").cast("int")).alias("padded"), F.count("*").alias("faces"))


@query("geo_raster_faces")
def geo_raster_faces(t):
    return heightmap.exploded(heightmap.heightmaps(contexts(t), 32, 32, fields=("height", "mask")), 32).groupBy("px", "py").agg(F.count("*").alias("texels"), F.sum((c("mask") == 0).cast("int")).alias("inside"))


_NEAR = f"""near AS (SELECT px, py, lz, r, (lx - (px + 0.5e0) * 640e0) / {number(C.RADIUS)} * {number(C.STRETCH)} AS nx, (ly - (py + 0.5e0) * 640e0) / {number(C.RADIUS)} * {number(C.STRETCH)} AS ny FROM ctx),
 big AS (SELECT px, py FROM near GROUP BY px, py HAVING count(*) >= 25), cells AS (SELECT * FROM big CROSS JOIN (SELECT unnest(range(8))::INT AS i) a CROSS JOIN (SELECT unnest(range(8))::INT AS j) b)"""


@query("geo_interp_nearest", f"""{_CONTEXT}, {_NEAR};; SELECT px, py, i, j, round(lz, 6) AS height FROM (SELECT c.px, c.py, i, j, lz, row_number() OVER (PARTITION BY c.px, c.py, i, j
  ORDER BY (-0.5e0 + i * 0.125e0 - nx) * (-0.5e0 + i * 0.125e0 - nx) + (-0.5e0 + j * 0.125e0 - ny) * (-0.5e0 + j * 0.125e0 - ny)) AS k FROM cells c JOIN near USING (px, py)) q WHERE k = 1""")
def geo_interp_nearest(t):
    return heightmap.exploded(heightmap.heightmaps(contexts(t), 8, 8, "nearest", fields=("height",)), 8).select("px", "py", "i", "j", F.round("height", 6).alias("height"))


@query("geo_interp_linear")
def geo_interp_linear(t):
    """Heights and colours (0 to 1) of all 96 x 96 texels."""
    fields = ("height", *heightmap.COLOURS)
    return heightmap.exploded(heightmap.heightmaps(contexts(t), C.CONTEXT_TEXELS, C.CONTEXT_TEXELS, fields=fields, decimals=6), C.CONTEXT_TEXELS).select("px", "py", "i", "j", *fields)


_NEAREST = """nr AS (SELECT px, py, lz, r, rank_k FROM (SELECT c.px, c.py, i, j, lz, r, row_number() OVER (PARTITION BY c.px, c.py, i, j
  ORDER BY (-0.5e0 + i * 0.125e0 - nx) * (-0.5e0 + i * 0.125e0 - nx) + (-0.5e0 + j * 0.125e0 - ny) * (-0.5e0 + j * 0.125e0 - ny)) AS rank_k FROM cells c JOIN near USING (px, py)) q WHERE rank_k = 1)"""


@query("geo_pts2hm", f"{_CONTEXT}, {_NEAR}, {_NEAREST};; SELECT p.px, p.py, p.n, p.n < 25 AS blank, q.total, q.low, q.high FROM (SELECT px, py, CAST(count(*) AS INT) AS n FROM ctx GROUP BY px, py) p "
       "LEFT JOIN (SELECT px, py, round(sum(lz), 2) AS total, round(min(lz), 4) AS low, round(max(lz), 4) AS high FROM nr GROUP BY px, py) q ON p.px = q.px AND p.py = q.py")
def geo_pts2hm(t):
    """Sum, least and greatest height of each patch's map; blank patches have none."""
    maps = heightmap.heightmaps(contexts(t), 8, 8, "nearest", fields=("height",))
    total = F.aggregate("height", F.lit(0.0), lambda a, x: a + x)
    return maps.select("px", "py", "n", "blank", F.round(total, 2).alias("total"), F.round(F.array_min("height"), 4).alias("low"), F.round(F.array_max("height"), 4).alias("high"))


@query("geo_linear_map")
def geo_linear_map(t):
    return heightmap.heightmaps(contexts(t), C.CONTEXT_TEXELS, C.CONTEXT_TEXELS, fields=("height",)).select("px", "py", "n", F.round(F.array_max("height"), 6).alias("top"))


_AT96 = [f"(-0.5e0 + {i} * {number(1 / 96)} - n{a})" for i, a in ("ix", "jy")]


@query("geo_crop", f"""{_CONTEXT}, {_NEAR.replace("range(8)", "range(96)")};; SELECT px, py, i - 16 AS i, j - 16 AS j, round(arg_min(lz, row({" + ".join(f"{a} * {a}" for a in _AT96)}, nx, ny, lz)), 6) AS height
  FROM cells JOIN near USING (px, py) WHERE i BETWEEN 16 AND 79 AND j BETWEEN 16 AND 79 GROUP BY px, py, i, j""")
def geo_crop(t):
    """The middle 64 x 64 texels of rasters of 96 x 96."""
    maps = heightmap.heightmaps(contexts(t), C.CONTEXT_TEXELS, C.CONTEXT_TEXELS, "nearest", fields=("height",), decimals=6)
    return heightmap.exploded(heightmap.cropped(maps)).select("px", "py", "i", "j", "height")


def smoothed(maps: np.ndarray) -> np.ndarray:
    """The 3 x 3 means of maps (channels x n x n), cropped to the learned size."""
    n = maps.shape[1]
    h = np.pad(maps, ((0, 0), (1, 1), (1, 1)), mode="edge")
    mean = sum(h[:, a : a + n, b : b + n] for a in range(3) for b in range(3)) / 9
    edge = (n - C.TEXELS) // 2
    return mean[:, edge : edge + C.TEXELS, edge : edge + C.TEXELS]


def mean_filter(maps: dict[str, np.ndarray]) -> np.ndarray:
    """A stand-in for a learned model of heights: the means of the linear ones."""
    return smoothed(maps["patch_hm_linear"])


def mean_filter_rgb(maps: dict[str, np.ndarray]) -> np.ndarray:
    """A stand-in for learned models of heights and colours: the means of both interpolations."""
    return smoothed(np.concatenate([(maps[f"patch_{a}_nearest"] + maps[f"patch_{a}_linear"]) / 2 for a in ("hm", "rgb")]))


@query("geo_gen_rgb")
def geo_gen_rgb(t):
    """The whole way of a patch: enough samples, normalised, both interpolations, the model's heights and colours, heights in metres, colours masked. Means of the finished maps."""
    maps = heightmap.heightmaps(contexts(t), model=mean_filter_rgb, means=True, masked=True)
    return maps.select("px", "py", "n", "blank", *[F.round(a, 4).alias(a) for a in ("height", "red", "green", "blue")])


@query("geo_gen_h")
def geo_gen_h(t):
    return heightmap.heightmaps(contexts(t), fields=("height",)).select("px", "py", "n", F.round(F.array_min("height"), 6).alias("low"), F.round(F.array_max("height"), 6).alias("high"))


@query("ml_infer")
def ml_infer(t):
    return heightmap.heightmaps(contexts(t), model=mean_filter, fields=("height",)).select("px", "py", "n", F.round(F.array_max("height"), 6).alias("top"))


@query("geo_voxel_mesh", "SELECT CAST(count(*) * 6 AS BIGINT) AS faces, count(*) AS voxels FROM (SELECT DISTINCT floor(x / 320e0), floor(y / 320e0), floor(z / 320e0) FROM ch) q")
def geo_voxel_mesh(t):
    from geolode.operators import raster

    voxels = t.chunk_points.select(*[C.cell(c(a), 320.0).alias(f"v{a}") for a in "xyz"]).distinct()
    low, high = ([(c(f"v{a}") + F.lit(at)) * 320.0 for a in "xyz"] for at in (0.02, 0.98))
    cubes = raster.box_triangles(voxels, low, high)
    return cubes.agg((F.count("*") / 2).cast("long").alias("faces"), F.count_distinct("vx", "vy", "vz").alias("voxels"))


@query("geo_tri_mesh", f"{_CONTEXT};; SELECT px, py, 2 * n + 2 AS faces, 4e0 AS area, 0e0 AS least FROM ({_DISTINCT}) q")
def geo_tri_mesh(t):
    """The mesh of each patch covers its square once: the areas of its faces are positive and sum up to it."""
    each = heightmap.faces(contexts(t)).groupBy("px", "py")
    return each.agg(F.count("*").alias("faces"), F.round(F.sum("area"), 6).alias("area"), F.round(F.least(F.min("area"), F.lit(0.0)), 6).alias("least"))


@query("jn_point_in_tri")
def jn_point_in_tri(t):
    """Which texels of each patch lie in a face of known corners."""
    return heightmap.exploded(heightmap.heightmaps(contexts(t), 16, 16, fields=("height", "mask")), 16).select("px", "py", "i", "j", "mask")


@query("patches", "SELECT px, py, count(*) AS n FROM chl GROUP BY px, py")
def all_patches(t):
    return patches(t)
