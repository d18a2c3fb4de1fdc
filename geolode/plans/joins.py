"""Joins, set operations, windows, sorts and limits."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import grid, neighbours
from geolode.plans import storage
from geolode.plans.registry import query

c = F.col
KEY = ("tile_id", "point_idx")

# file names of tiles, and what a chunk table says of them; some tables are of unknown files
_FILES = "files AS (SELECT tile_id, 'tile_' || tile_id || '.las' AS path FROM tiles), infos AS (SELECT 'tile_' || (tile_id + 3) || '.las' AS path, (n_points + 9) // 10 AS n_chunks FROM tiles)"


def file_tables(t):
    name = lambda k: F.concat(F.lit("tile_"), k.cast("string"), F.lit(".las"))
    return t.tiles.select("tile_id", name(c("tile_id")).alias("path")), t.tiles.select(name(c("tile_id") + 3).alias("path"), C.chunk_count(c("n_points"), 10).alias("n_chunks"))


@query("jn_hash_path", _FILES + ";; SELECT i.path, n_chunks, tile_id, tile_id IS NULL AS unknown FROM infos i LEFT JOIN files f ON i.path = f.path")
def jn_hash_path(t):
    files, infos = file_tables(t)
    return infos.join(files, "path", "left").select("path", "n_chunks", "tile_id", c("tile_id").isNull().alias("unknown"))


_PATCHES = "patches AS (SELECT px, py, count(*) AS n FROM chl GROUP BY px, py)"


def patches(t):
    return t.placed(t.chunk_points).groupBy("px", "py").agg(F.count("*").alias("n"))


@query("jn_hash_patch", _PATCHES + ";; SELECT tile_id, point_idx, n FROM loc JOIN patches USING (px, py)")
def jn_hash_patch(t):
    return t.placed(t.points).join(patches(t), ["px", "py"]).select(*KEY, "n")


@query("jn_chunk_tile", "SELECT p.tile_id, point_idx // 10 AS chunk_idx, count(*) AS n, n_points FROM pts p JOIN tiles t ON p.tile_id = t.tile_id GROUP BY ALL")
def jn_chunk_tile(t):
    chunks = t.points.groupBy("tile_id", F.floor(c("point_idx") / 10).alias("chunk_idx")).agg(F.count("*").alias("n"))
    return chunks.join(t.tiles.select("tile_id", "n_points"), "tile_id").select("tile_id", "chunk_idx", "n", "n_points")


def tile_cells(t, beyond=False, closed=False):
    at = t.tiles.join(F.broadcast(t.world)).select("tile_id", *[(c(f"{n}_{a}") - c(f"origin_{a}")).alias(f"{n}_{a}") for n in ("min", "max") for a in "xy"])
    return grid.covered_cells(at, c("min_x"), c("min_y"), c("max_x"), c("max_y"), beyond=beyond, closed=closed)


@query("jn_bbox_overlap", _PATCHES + """;; SELECT px, py, tile_id FROM patches JOIN (SELECT tile_id, min_x - origin_x AS ax, max_x - origin_x AS bx, min_y - origin_y AS ay, max_y - origin_y AS b_y FROM tiles CROSS JOIN world) q
  ON ax <= (px + 1) * 640e0 AND px * 640e0 <= bx AND ay <= (py + 1) * 640e0 AND py * 640e0 <= b_y""")
def jn_bbox_overlap(t):
    return tile_cells(t, closed=True).join(patches(t).select("px", "py"), ["px", "py"]).select("px", "py", "tile_id")


@query("jn_tile_patches", """SELECT DISTINCT px, py FROM (SELECT px, unnest(range(CAST(floor(ay / 640e0) AS INT), CAST(ceil(b_y / 640e0) AS INT) + 1))::INT AS py FROM (
  SELECT ay, b_y, unnest(range(CAST(floor(ax / 640e0) AS INT), CAST(ceil(bx / 640e0) AS INT) + 1))::INT AS px FROM (
  SELECT min_x - origin_x AS ax, max_x - origin_x AS bx, min_y - origin_y AS ay, max_y - origin_y AS b_y FROM tiles CROSS JOIN world) q) q) q""")
def jn_tile_patches(t):
    return tile_cells(t, beyond=True).select("px", "py").distinct()


@query("jn_point_tile", "SELECT t.tile_id, count(*) AS inside FROM tiles t JOIN ch ON x >= min_x AND x <= max_x AND y >= min_y AND y <= max_y AND z >= min_z AND z <= max_z GROUP BY t.tile_id")
def jn_point_tile(t):
    boxes = grid.covered_cells(t.tiles, c("min_x"), c("min_y"), c("max_x"), c("max_y"))
    points = t.chunk_points.select(*"xyz", C.cell(c("x")).alias("px"), C.cell(c("y")).alias("py"))
    inside = C.inside([c(a) for a in "xyz"], [c(f"min_{a}") for a in "xyz"], [c(f"max_{a}") for a in "xyz"])
    return boxes.join(points, ["px", "py"]).filter(inside).groupBy("tile_id").agg(F.count("*").alias("inside"))


_CONTEXT = _PATCHES + """, ctx AS (SELECT p.px, p.py, lx, ly, lz, zi, tile_id, point_idx, r, g, b FROM patches p JOIN (SELECT * EXCLUDE (px, py) FROM chl) q
  ON lx >= p.px * 640e0 - 161e0 AND lx <= (p.px + 1) * 640e0 + 161e0 AND ly >= p.py * 640e0 - 161e0 AND ly <= (p.py + 1) * 640e0 + 161e0)"""


def chunk_state(tile, chunk):
    """A state by chunk, for the queries that look at loading."""
    return (tile * 7 + chunk) % 4


def contexts(t):
    at = t.placed(t.chunk_points)
    return grid.context(at, at.select("px", "py").distinct())


@query("jn_context", _CONTEXT + ";; SELECT px, py, count(*) AS n, sum(zi) / count(*) AS mean_z FROM ctx GROUP BY px, py")
def jn_context(t):
    return contexts(t).groupBy("px", "py").agg(F.count("*").alias("n"), (F.sum("zi") / F.count("*")).alias("mean_z"))


@query("jn_neighbor_regions", _PATCHES + ";; SELECT a.px, a.py, count(*) AS beside, CAST(sum(b.n) AS BIGINT) AS points FROM patches a JOIN patches b ON abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 AND (a.px <> b.px OR a.py <> b.py) GROUP BY a.px, a.py")
def jn_neighbor_regions(t):
    each = patches(t)
    sent = grid.with_neighbours(each).filter("px <> to_px OR py <> to_py").select(c("to_px").alias("px"), c("to_py").alias("py"), c("n").alias("m"))
    return each.select("px", "py").join(sent, ["px", "py"]).groupBy("px", "py").agg(F.count("*").alias("beside"), F.sum("m").alias("points"))


_GRID = "g AS (SELECT px, py, i, j, px * 640e0 + i * 160e0 + 80e0 AS qx, py * 640e0 + j * 160e0 + 80e0 AS qy FROM (SELECT px, py, i, unnest(range(4)) AS j FROM (SELECT px, py, unnest(range(4)) AS i FROM patches) q) q)"


def grid_points(some):
    """4 x 4 places of each patch (px, py)."""
    cells = some.select("px", "py").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return cells.withColumns({"qx": c("px") * 640.0 + c("i") * 160.0 + 80.0, "qy": c("py") * 640.0 + c("j") * 160.0 + 80.0})


def identified(points):
    return points.select("px", "py", c("lx").alias("x"), c("ly").alias("y"), (c("tile_id") * 1000000 + c("point_idx")).alias("id"))


def _neighbours(t, k):
    # numbered and placed once; the patches are those of the same rows
    at = storage.kept(identified(t.placed(t.chunk_points)))
    return neighbours.nearest(at, grid_points(at.select("px", "py").distinct()), k)


_DIST = "(lx - qx) * (lx - qx) + (ly - qy) * (ly - qy)"


@query("jn_nn", f"{_PATCHES}, {_GRID};; SELECT px, py, i, j, id, d2 FROM (SELECT g.px, g.py, i, j, tile_id * 1000000 + point_idx AS id, {_DIST} AS d2, "
       f"row_number() OVER (PARTITION BY g.px, g.py, i, j ORDER BY {_DIST}, tile_id * 1000000 + point_idx) AS k FROM g CROSS JOIN (SELECT lx, ly, tile_id, point_idx FROM chl) q) q WHERE k = 1")
def jn_nn(t):
    """The nearest chunk point of all, for each point of a grid over the patches."""
    return _neighbours(t, 1).select("px", "py", "i", "j", "id", "d2")


@query("jn_knn", f"{_PATCHES}, {_GRID};; SELECT px, py, i, j, id, k FROM (SELECT g.px, g.py, i, j, tile_id * 1000000 + point_idx AS id, "
       f"CAST(row_number() OVER (PARTITION BY g.px, g.py, i, j ORDER BY {_DIST}, tile_id * 1000000 + point_idx) AS INT) AS k FROM g CROSS JOIN (SELECT lx, ly, tile_id, point_idx FROM chl) q) q WHERE k <= 3")
def jn_knn(t):
    return _neighbours(t, 3).select("px", "py", "i", "j", "id", c("rank").alias("k"))


@query("jn_ball", f"{_PATCHES}, {_GRID};; SELECT px, py, i, j, count(*) AS n FROM g JOIN (SELECT lx, ly FROM chl) q ON {_DIST} <= 3600e0 GROUP BY px, py, i, j")
def jn_ball(t):
    at = t.placed(t.chunk_points).select(c("lx").alias("x"), c("ly").alias("y"), F.lit(0).alias("id"))
    return grid.within(at, grid_points(patches(t)), 60.0).groupBy("px", "py", "i", "j").agg(F.count("*").alias("n"))


_TEX = "tx AS (SELECT CAST(floor((lx + 5e0) / 10e0) AS INT) AS gx, CAST(floor((ly + 5e0) / 10e0) AS INT) AS gy, CAST(floor(sum(r) / count(*)) AS INT) AS r FROM loc GROUP BY 1, 2)"


def texels(t):
    at = t.placed(t.points)
    return at.groupBy(C.texel(c("lx")).alias("gx"), C.texel(c("ly")).alias("gy")).agg(F.floor(F.sum("r") / F.count("*")).cast("int").alias("r"))


@query("jn_raster_lookup", _TEX + ";; SELECT tile_id, point_idx, coalesce(tx.r, 0) AS r FROM chl LEFT JOIN tx ON gx = CAST(floor((lx + 5e0) / 10e0) AS INT) AND gy = CAST(floor((ly + 5e0) / 10e0) AS INT)")
def jn_raster_lookup(t):
    at = t.placed(t.chunk_points).select(*KEY, C.texel(c("lx")).alias("gx"), C.texel(c("ly")).alias("gy"))
    return at.join(texels(t), ["gx", "gy"], "left").select(*KEY, F.coalesce("r", F.lit(0)).alias("r"))


@query("jn_bilinear", _TEX + """, o AS (SELECT unnest([0, 1]) AS d);; SELECT tile_id, point_idx, round(sum((CASE WHEN ox.d = 1 THEN u ELSE 1 - u END) * (CASE WHEN oy.d = 1 THEN v ELSE 1 - v END) * coalesce(tx.r, 0)), 6) AS r
  FROM (SELECT tile_id, point_idx, CAST(floor(lx / 10e0) AS INT) AS ix, CAST(floor(ly / 10e0) AS INT) AS iy, lx / 10e0 - floor(lx / 10e0) AS u, ly / 10e0 - floor(ly / 10e0) AS v FROM chl) q
  CROSS JOIN o ox CROSS JOIN o oy LEFT JOIN tx ON gx = ix + ox.d AND gy = iy + oy.d GROUP BY tile_id, point_idx""")
def jn_bilinear(t):
    at = t.placed(t.chunk_points).select(*KEY, C.cell(c("lx"), 10.0).alias("ix"), C.cell(c("ly"), 10.0).alias("iy"), *[(c(f"l{a}") / 10.0 - F.floor(c(f"l{a}") / 10.0)).alias(n) for a, n in (("x", "u"), ("y", "v"))])
    part = lambda n, d: c(n) if d else 1 - c(n)
    corners = [F.struct((c("ix") + dx).alias("gx"), (c("iy") + dy).alias("gy"), (part("u", dx) * part("v", dy)).alias("w")) for dx in (0, 1) for dy in (0, 1)]
    near = at.select(*KEY, F.explode(F.array(*corners)).alias("k")).select(*KEY, "k.*").join(texels(t), ["gx", "gy"], "left")
    return near.groupBy(*KEY).agg(F.round(F.sum(c("w") * F.coalesce("r", F.lit(0))), 6).alias("r"))


@query("jn_cross_tri_vertex", _PATCHES + """;; SELECT px, py, CAST(count(*) AS BIGINT) AS triangles, round(sum(gx * 3 + 2 - h) / 64e0, 6) AS u, round(sum(gy * 3 + 1 + h) / 64e0, 6) AS v
  FROM patches CROSS JOIN (SELECT unnest(range(64)) AS gx) a CROSS JOIN (SELECT unnest(range(64)) AS gy) b CROSS JOIN (SELECT unnest([0, 1]) AS h) d GROUP BY px, py""")
def jn_cross_tri_vertex(t):
    from geolode.operators import raster

    mesh = raster.grid_mesh(patches(t).select("px", "py"))
    total = lambda a: F.round(F.sum(c(f"{a}0") + c(f"{a}1") + c(f"{a}2")), 6).alias(a)
    return mesh.groupBy("px", "py").agg(F.count("*").alias("triangles"), total("u"), total("v"))


_DONE = "done AS (SELECT px, py FROM patches WHERE n >= 25)"


@query("jn_anti", f"{_PATCHES}, {_DONE};; SELECT px, py FROM patches WHERE NOT EXISTS (SELECT 1 FROM done WHERE done.px = patches.px AND done.py = patches.py)")
def jn_anti(t):
    each = patches(t)
    return each.join(each.filter("n >= 25").select("px", "py"), ["px", "py"], "left_anti").select("px", "py")


@query("jn_semi", f"{_PATCHES}, {_DONE};; SELECT tile_id, point_idx FROM chl WHERE EXISTS (SELECT 1 FROM done WHERE done.px = chl.px AND done.py = chl.py)")
def jn_semi(t):
    return t.placed(t.chunk_points).join(patches(t).filter("n >= 25"), ["px", "py"], "left_semi").select(*KEY)


@query("set_union", "SELECT tile_id, point_idx FROM pts WHERE point_idx % 2 = 0 UNION ALL SELECT tile_id, point_idx FROM pts WHERE point_idx % 3 = 0")
def set_union(t):
    return grid.every(t.points, "point_idx", 2).select(*KEY).unionByName(grid.every(t.points, "point_idx", 3).select(*KEY))


@query("set_distinct", "SELECT DISTINCT px, py FROM loc")
def set_distinct(t):
    return t.placed(t.points).select("px", "py").dropDuplicates(["px", "py"])


@query("set_dup_files", "SELECT tile_id, k FROM (SELECT tile_id, unnest(range(3)) AS k FROM tiles) q")
def set_dup_files(t):
    return t.tiles.select("tile_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("k"))


@query("set_minus", "SELECT tile_id FROM tiles EXCEPT SELECT tile_id FROM pts WHERE r > 250")
def set_minus(t):
    return t.tiles.select("tile_id").join(t.points.filter("r > 250").select("tile_id"), "tile_id", "left_anti")


# sizes of chunks as a chunk table has them
_SIZES = "sizes AS (SELECT tile_id, point_idx // 10 AS chunk_idx, CAST(sum(zi) + 100 AS BIGINT) AS byte_size FROM pts GROUP BY 1, 2)"


def chunk_sizes(t):
    return t.points.groupBy("tile_id", F.floor(c("point_idx") / 10).alias("chunk_idx")).agg((F.sum("zi") + 100).alias("byte_size"))


@query("win_prefix_sum", _SIZES + ";; SELECT tile_id, chunk_idx, CAST(375 + 8 + coalesce(sum(byte_size) OVER (PARTITION BY tile_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM sizes")
def win_prefix_sum(t):
    from geolode.sources.las import chunk_offsets

    return chunk_offsets(chunk_sizes(t), ["tile_id"], F.lit(375)).select("tile_id", "chunk_idx", "byte_offset")


@query("src_chunk_offset", _SIZES + ";; SELECT tile_id, chunk_idx, byte_size, CAST(235 + coalesce(sum(byte_size) OVER (PARTITION BY tile_id ORDER BY chunk_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_offset FROM sizes")
def src_chunk_offset(t):
    from geolode.sources.las import chunk_offsets

    return chunk_offsets(chunk_sizes(t), ["tile_id"], F.lit(227))


@query("src_las_chunks", "SELECT tile_id, k * 10 AS first, 227 + k * 10 * 26 AS byte_offset FROM (SELECT tile_id, unnest(range(0, (n_points + 9) // 10)) AS k FROM tiles) q")
def src_las_chunks(t):
    from geolode.sources.las import even_chunks

    return even_chunks(t.tiles.select("tile_id", "n_points", F.lit(227).cast("long").alias("data_offset"), F.lit(26).cast("long").alias("record_length")), 10).select("tile_id", "first", "byte_offset")


@query("win_point_idx", "SELECT tile_id, point_idx, point_idx // 10 AS chunk_idx FROM pts")
def win_point_idx(t):
    return t.points.select(*KEY, F.floor(c("point_idx") / 10).alias("chunk_idx"))


@query("win_lerp", """SELECT event_id, round(value + (after - value) * 0.25e0, 6) AS v FROM (SELECT event_id, value, coalesce(lead(value) OVER (PARTITION BY user_id ORDER BY ts, event_id), value) AS after FROM events) q""")
def win_lerp(t):
    after = F.coalesce(F.lead("value").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), c("value"))
    return t.read("events").select("event_id", F.round(C.lerp(c("value"), after, F.lit(0.25)), 6).alias("v"))


@query("srt_heights", "SELECT z, count(*) AS n FROM ch GROUP BY z ORDER BY z")
def srt_heights(t):
    return t.chunk_points.groupBy("z").agg(F.count("*").alias("n")).orderBy("z")


@query("srt_files", "SELECT tile_id, CAST(row_number() OVER (ORDER BY min_x >= 3000 DESC, n_points DESC, tile_id) AS INT) AS place FROM tiles")
def srt_files(t):
    return storage.placed_in_order(t.tiles, F.desc(c("min_x") >= 3000), F.desc("n_points"), "tile_id").select("tile_id", c("place").cast("int").alias("place"))


#: Points that a patch holds (fixed value).
CAPACITY = 1500


@query("lim_points_patch", "SELECT tile_id, point_idx FROM (SELECT *, row_number() OVER (PARTITION BY px, py ORDER BY tile_id, point_idx) AS k FROM loc) q WHERE k <= 1500")
def lim_points_patch(t):
    return grid.first_of_each(t.placed(t.points), ["px", "py"], KEY, CAPACITY).select(*KEY)
