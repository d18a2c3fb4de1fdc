"""Aggregations and rasters of points."""

from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import aggregate, lod, raster
from geolode.plans.joins import _CONTEXT, _PATCHES, chunk_state, contexts, patches
from geolode.plans.registry import query

c = F.col


@query("agg_world_bounds", "SELECT * FROM world")
def agg_world_bounds(t):
    return t.world


@query("agg_total_points", "SELECT CAST(sum(n_points) AS BIGINT) AS n FROM tiles")
def agg_total_points(t):
    return t.tiles.agg(F.sum("n_points").alias("n"))


_MEANS = ", ".join(f"CAST(floor(sum({a}) / count(*)) AS INT) AS {a}" for a in "rgb")


@query("agg_file_color", f"SELECT tile_id, {_MEANS}, count(*) AS n FROM ch GROUP BY tile_id")
def agg_file_color(t):
    return aggregate.mean_colour(t.chunk_points, "tile_id")


@query("agg_file_color_atomic", f"SELECT t.tile_id, coalesce(q.r, 0) AS r, coalesce(q.g, 0) AS g, coalesce(q.b, 0) AS b FROM tiles t LEFT JOIN (SELECT tile_id, {_MEANS} FROM ch GROUP BY tile_id) q ON t.tile_id = q.tile_id")
def agg_file_color_atomic(t):
    seen = aggregate.mean_colour(t.chunk_points, "tile_id")
    return t.tiles.select("tile_id").join(seen, "tile_id", "left").select("tile_id", *[F.coalesce(a, F.lit(0)).alias(a) for a in "rgb"])


@query("agg_bounds_file", "SELECT * FROM tiles")
def agg_bounds_file(t):
    return t.tiles


@query("agg_chunk_color", f"SELECT tile_id, point_idx // 10 AS chunk_idx, {_MEANS}, count(*) AS n FROM pts GROUP BY 1, 2")
def agg_chunk_color(t):
    return aggregate.mean_colour(t.points.withColumn("chunk_idx", F.floor(c("point_idx") / 10)), "tile_id", "chunk_idx")


_G = "CAST(floor((l{a} + 5e0) / 10e0) AS INT)"
_TEXELS = ", ".join(f"{_G.format(a=a)} // 64 AS p{a}, {_G.format(a=a)} % 64 AS t{a}" for a in "xy")


@query("agg_texture", f"{_PATCHES};; SELECT px, py, tx, ty, {_MEANS}, count(*) AS n FROM (SELECT r, g, b, {_TEXELS} FROM loc) q SEMI JOIN (SELECT * FROM patches WHERE n >= 25) k USING (px, py) GROUP BY px, py, tx, ty HAVING count(*) > 2")
def agg_texture(t):
    at = t.placed(t.points).drop("px", "py").withColumns({f"g{a}": C.texel(c(f"l{a}")) for a in "xy"})
    at = at.select(*"rgb", *[e for a in "xy" for e in (F.floor(c(f"g{a}") / C.TEXELS).cast("int").alias(f"p{a}"), F.pmod(c(f"g{a}"), F.lit(C.TEXELS)).alias(f"t{a}"))])
    return aggregate.textures(at, patches(t).filter("n >= 25"))


_SECT = "CASE WHEN l{a} - p{a} * 640e0 <= 160e0 THEN 0 WHEN l{a} - p{a} * 640e0 < 480e0 THEN 1 ELSE 2 END AS s{a}"


@query("agg_patch_count", f"SELECT px, py, sy, sx, count(*) AS n FROM (SELECT px, py, {_SECT.format(a='x')}, {_SECT.format(a='y')} FROM chl) q GROUP BY px, py, sy, sx")
def agg_patch_count(t):
    at = t.placed(t.chunk_points).withColumns({f"s{a}": C.sector(c(f"l{a}"), C.patch_edge(c(f"p{a}"))) for a in "xy"})
    return at.groupBy("px", "py", "sy", "sx").agg(F.count("*").alias("n"))


@query("agg_patch_meanz", _CONTEXT + ";; SELECT px, py, sum(zi) / count(*) * 1e-2 AS mean_z FROM ctx GROUP BY px, py")
def agg_patch_meanz(t):
    return contexts(t).groupBy("px", "py").agg((F.sum("zi") / F.count("*") * 1e-2).alias("mean_z"))


@query("agg_patch_minmaxz", _CONTEXT + ";; SELECT px, py, min(lz) AS low, max(lz) AS high FROM ctx GROUP BY px, py")
def agg_patch_minmaxz(t):
    return contexts(t).groupBy("px", "py").agg(F.min("lz").alias("low"), F.max("lz").alias("high"))


_COVERED = "unnest(range(CAST(floor((min_{a} - origin_{a}) / 640e0) AS INT), CAST(ceil((max_{a} - origin_{a}) / 640e0) AS INT) + 1))"


@query("agg_median_height", f"""SELECT mid AS median FROM (SELECT mid, row_number() OVER (ORDER BY mid) AS k, count(*) OVER () AS n FROM (
  SELECT mid, {_COVERED.format(a='y')} AS py FROM (SELECT *, (min_z + max_z) * 0.5e0 AS mid, {_COVERED.format(a='x')} AS px FROM tiles CROSS JOIN world) q) q) q WHERE k = n // 2 + 1""")
def agg_median_height(t):
    """The middle of the tiles' mean heights, each counted for every patch that the tile covers (and one beyond, as the loader makes them)."""
    at = t.tiles.join(F.broadcast(t.world))
    n = [F.ceil((c(f"max_{a}") - c(f"origin_{a}")) / C.PATCH) - F.floor((c(f"min_{a}") - c(f"origin_{a}")) / C.PATCH) + 1 for a in "xy"]
    return aggregate.upper_median(at.select(((c("min_z") + c("max_z")) * 0.5).alias("mid"), (n[0] * n[1]).alias("n")), "mid", c("n"))


@query("agg_maxheight", "SELECT CAST(floor(lx / 10e0) AS INT) AS ix, CAST(floor(ly / 10e0) AS INT) AS iy, greatest(max(z), 0e0) AS height FROM loc GROUP BY 1, 2")
def agg_maxheight(t):
    return raster.highest(t.placed(t.points))


_SPLAT = """smp AS (SELECT px, py, CAST(floor(greatest(0e0, least(95e0, (lx - (px + 0.5e0) * 640e0 + 480e0) / 10e0))) AS INT) AS ix, CAST(floor(greatest(0e0, least(95e0, (ly - (py + 0.5e0) * 640e0 + 480e0) / 10e0))) AS INT) AS iy, 100e0 + lz / 2e0 AS h FROM ctx),
 o AS (SELECT unnest(range(-10, 11))::INT AS d), w AS (SELECT ox.d AS dx, oy.d AS dy, 1e0 - exp(-greatest(0e0, least(1e0, 1e0 - sqrt(CAST(ox.d * ox.d + oy.d * oy.d AS DOUBLE)) / 10e0)) / 10.1e0) AS w FROM o ox CROSS JOIN o oy)"""


@query("agg_splat", f"{_CONTEXT}, {_SPLAT};; SELECT px, py, ix + dx AS ix, iy + dy AS iy, round(sum(h * w) / sum(w), 6) AS h, count(*) AS n FROM smp CROSS JOIN w WHERE w > 0 AND ix + dx BETWEEN 0 AND 95 AND iy + dy BETWEEN 0 AND 95 GROUP BY 1, 2, 3, 4")
def agg_splat(t):
    """Heights (100 and half the height) of a patch's context splatted over its 96 x 96 texels."""
    texel = lambda a: F.floor(C.clamp((c(f"l{a}") - C.patch_edge(c(f"p{a}"), 0.5) + 480.0) / 10.0, 0.0, 95.0)).cast("int")
    return raster.splat(contexts(t).select("px", "py", texel("x").alias("ix"), texel("y").alias("iy"), (100.0 + c("lz") / 2).alias("h")), ["px", "py"], C.CONTEXT_TEXELS)


@query("agg_progress", """SELECT px, py, count(*) AS parts, CAST(sum(CASE WHEN coalesce(n, 0) >= expected THEN 1 ELSE 0 END) AS BIGINT) AS parts_done, bool_and(coalesce(n, 0) >= expected) AS complete
  FROM (SELECT px, py, tile_id, count(*) AS expected FROM chl GROUP BY px, py, tile_id) t LEFT JOIN (SELECT px AS x, py AS y, tile_id AS id, count(*) AS n FROM chl WHERE (tile_id * 7 + point_idx // 10) % 4 = 2 GROUP BY 1, 2, 3) l
  ON t.tile_id = l.id AND px = x AND py = y GROUP BY px, py""")
def agg_progress(t):
    """By patch: how many of its tiles have all their chunk points there loaded."""
    at = t.placed(t.chunk_points).withColumn("key", F.struct("px", "py", "tile_id"))
    expected = at.groupBy("key").agg(F.count("*").alias("expected")).select("key", "expected", F.struct("key.px", "key.py").alias("patch"))
    loaded = at.filter(chunk_state(c("tile_id"), F.floor(c("point_idx") / 10)) == lod.LOADED).select("key")
    return aggregate.progress(expected, loaded, "key", "patch").select("patch.px", "patch.py", "parts", "parts_done", "complete")


@query("agg_stats_table", "SELECT (SELECT CAST(sum(n_points) AS BIGINT) FROM tiles) AS points, (SELECT count(*) FROM tiles) AS tiles, (SELECT count(*) FROM ch) AS chunks, (SELECT count(*) FROM (SELECT DISTINCT px, py FROM chl) q) AS patches, size_x, size_y, size_z FROM world")
def agg_stats_table(t):
    totals = t.tiles.agg(F.sum("n_points").alias("points"), F.count("*").alias("tiles"), F.sum(C.chunk_count(c("n_points"), 10)).alias("chunks"))
    grid_size = t.placed(t.chunk_points).select("px", "py").distinct().agg(F.count("*").alias("patches"))
    return totals.join(F.broadcast(grid_size)).join(F.broadcast(t.world.select("size_x", "size_y", "size_z")))  # one row each


@query("snk_stats_copy", "SELECT 'points' AS name, CAST(sum(n_points) AS VARCHAR) AS value FROM tiles UNION ALL SELECT 'tiles', CAST(count(*) AS VARCHAR) FROM tiles")
def snk_stats_copy(t):
    totals = t.tiles.agg(F.sum("n_points").cast("string").alias("points"), F.count("*").cast("string").alias("tiles"))
    return totals.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), c(n).alias("value")) for n in ("points", "tiles")])).alias("s")).select("s.*")
