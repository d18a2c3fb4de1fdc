"""Files: listings, LAS headers, chunk tables, chunk points, ranges, text formats and written forms.

The tables of the tests hold no LAS files, so each tile's points are first written as a file's bytes (path, content), which is what
the binaryFile source gives for small files, and then read by the same functions as the ``las`` source uses.
"""


from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import raster
from geolode.plans.joins import contexts
from geolode.plans.registry import query
from geolode.sources import las, sinks, text

c = F.col
TILE = lambda: F.regexp_extract("path", r"(\d+)", 1).cast("long").alias("tile_id")
OPTIONS = {"chunk": 10}


def files(t, **options):
    return las.encode_tiles(t.points, **(OPTIONS | options))


_NAMES = "names AS (SELECT s_suppkey, 'Dir' || s_suppkey % 3 || '/' || s_suppkey || CASE s_suppkey % 4 WHEN 0 THEN '.las' WHEN 1 THEN '.LAZ' WHEN 2 THEN '.txt' ELSE '.las.bak' END AS path FROM supplier)"


def names(t):
    k = c("s_suppkey")
    end = F.when(k % 4 == 0, ".las").when(k % 4 == 1, ".LAZ").when(k % 4 == 2, ".txt").otherwise(".las.bak")
    return t.read("supplier").select("s_suppkey", F.concat(F.lit("Dir"), (k % 3).cast("string"), F.lit("/"), k.cast("string"), end).alias("path"))


@query("src_ext_filter", _NAMES + ";; SELECT path FROM names WHERE ends_with(lower(path), '.las') OR ends_with(lower(path), '.laz')")
def src_ext_filter(t):
    return names(t).filter(las.is_point_file(c("path"))).select("path")


@query("src_list")
def src_list(t):
    return las.list_files(t.spark, t.sf_dir, pattern="*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


@query("src_list_rec")
def src_list_rec(t):
    return las.list_files(t.spark, t.sf_dir, recursive=True, pattern="*.parquet").select(F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "length")


_HEADER = "SELECT tile_id, {version} AS version, {kind} AS point_format, n_points, min_x, min_y, min_z, max_x, max_y, max_z, (n_points + 9) // 10 AS n_chunks FROM tiles"


def headers(found):
    return found.select(TILE(), "version", "point_format", "n_points", *[F.round(f"{n}_{a}", 2).alias(f"{n}_{a}") for n in ("min", "max") for a in "xyz"], F.ceil(c("n_points") / 10).alias("n_chunks"))


@query("src_las_header", _HEADER.format(version=2, kind=2).replace("min_x, min_y, min_z, max_x, max_y, max_z", ", ".join(f"round({n}_{a}, 2) AS {n}_{a}" for n in ("min", "max") for a in "xyz")))
def src_las_header(t):
    return headers(las.headers_of(files(t)))


@query("src_las_header_v", _HEADER.format(version=4, kind=7).replace("min_x, min_y, min_z, max_x, max_y, max_z", ", ".join(f"round({n}_{a}, 2) AS {n}_{a}" for n in ("min", "max") for a in "xyz")))
def src_las_header_v(t):
    return headers(las.headers_of(files(t, version=4, point_format=7)))


@query("src_laz_meta", "SELECT tile_id, true AS compressed, CAST(10 AS BIGINT) AS chunk_size, (n_points + 9) // 10 AS n_chunks, CAST(375 + 100 AS BIGINT) AS data_offset FROM tiles")
def src_laz_meta(t):
    found = las.headers_of(files(t, version=4, point_format=7, compressed=True))
    return found.select(TILE(), "compressed", "chunk_size", "n_chunks", "data_offset")


@query("src_vlr", "SELECT tile_id, CAST(10 AS BIGINT) AS chunk_size FROM tiles UNION ALL SELECT tile_id, CAST(50000 AS BIGINT) FROM tiles")
def src_vlr(t):
    """The chunk size comes from the compressor's record; files without it have chunks of the usual size."""
    return las.headers_of(files(t, compressed=True)).unionByName(las.headers_of(files(t))).select(TILE(), "chunk_size")


@query("src_chunk_table", "SELECT tile_id, k AS chunk_idx, CAST(26 + 7 * (k % 5) AS BIGINT) AS byte_size FROM (SELECT tile_id, unnest(range(0, (n_points + 9) // 10)) AS k FROM tiles) q")
def src_chunk_table(t):
    return las.chunk_tables_of(files(t, compressed=True)).select(TILE(), "chunk_idx", "byte_size")


_CHUNK_POINTS = "SELECT tile_id, point_idx, xi, yi, zi, r, g, b FROM ch"


@query("src_chunk_point", _CHUNK_POINTS)
def src_chunk_point(t):
    return las.chunk_points_of(files(t, compressed=True)).select(TILE(), "point_idx", "xi", "yi", "zi", *"rgb")


@query("src_chunk_point_icp", _CHUNK_POINTS)
def src_chunk_point_icp(t):
    """The same from uncompressed files, whose chunks are runs of records."""
    return las.chunk_points_of(files(t), 10).select(TILE(), "point_idx", "xi", "yi", "zi", *"rgb")


@query("src_point_decode", "SELECT tile_id, point_idx, x, y, z, r, g, b, 255 AS a FROM pts")
def src_point_decode(t):
    return las.points_of(files(t)).select(TILE(), "point_idx", *"xyzrgb", "a")


@query("src_las_range", f"SELECT tile_id, point_idx, {', '.join(f'greatest(0e0, least(size_{a}, {a} - origin_{a})) AS l{a}' for a in 'xyz')} FROM pts CROSS JOIN world WHERE point_idx >= 20 AND point_idx < 45")
def src_las_range(t):
    """Records 20 to 44 of each file, moved to the world's origin and held inside its bounds."""
    at = las.points_of(files(t), 20, 25).join(F.broadcast(t.world))  # one row
    return at.select(TILE(), "point_idx", *[C.local(c(a), c(f"origin_{a}"), c(f"size_{a}")).alias(f"l{a}") for a in "xyz"])


@query("src_las_py", "SELECT tile_id, count(*) AS n, CAST(sum(xi) AS BIGINT) AS sx FROM pts GROUP BY tile_id")
def src_las_py(t):
    return las.points_of(files(t, version=3, point_format=3)).groupBy(TILE()).agg(F.count("*").alias("n"), F.sum("xi").alias("sx"))


def as_lines(df, order, *parts):
    """A small text file of lines for each tile."""
    return df.groupBy("tile_id").agg(F.sort_array(F.collect_list(F.struct(order, F.concat_ws(" ", *parts).alias("line")))).alias("l")).select(F.concat(F.lit("f"), c("tile_id").cast("string")).alias("path"), c("l.line").alias("l"))


def exploded(df, head):
    return df.select("path", F.posexplode(F.concat(F.array(*[F.lit(h) for h in head]), "l")).alias("n", "line"))


@query("src_ply", "SELECT tile_id, CAST(point_idx AS INT) // 10 AS n, x, y, z, r, g, b, 255 AS a FROM ch")
def src_ply(t):
    body = as_lines(t.chunk_points, "point_idx", *[c(a).cast("string") for a in "xyzrgb"], F.lit("255"))
    return text.ply(exploded(body, ["ply", "format ascii 1.0", "end_header"])).select(TILE(), "n", *"xyzrgba")


@query("src_camera_text", "SELECT tile_id, point_idx, x AS time, y AS yaw, z AS pitch FROM ch")
def src_camera_text(t):
    body = as_lines(t.chunk_points, "point_idx", *[c(a).cast("string") for a in "xyzrgb"], c("point_idx").cast("string"))
    return text.cameras(exploded(body, ["time yaw pitch radius x y z"])).select(TILE(), c("target_z").cast("long").alias("point_idx"), "time", "yaw", "pitch")


@query("src_poly", "SELECT tile_id, CAST(point_idx AS INT) AS id, x, y FROM ch")
def src_poly(t):
    body = as_lines(t.chunk_points, "point_idx", c("point_idx").cast("string"), c("x").cast("string"), c("y").cast("string"))
    headed = body.select("path", F.concat(F.array(F.concat_ws(" ", F.size("l").cast("string"), F.lit("2 0 0 # points"))), "l").alias("l"))
    return text.poly_points(exploded(headed, [])).select(TILE(), "id", "x", "y")


_CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))


@query("src_obj", f"""o AS (SELECT * FROM (VALUES {", ".join(f"({h}, {k}, {dx}, {dy})" for h, t in enumerate(((0, 1, 2), (0, 2, 3))) for k, (dx, dy) in enumerate(_CORNERS[i] for i in t))}) v(half, corner, dx, dy))
 ;; SELECT tile_id, point_idx // 10 * 2 + half AS triangle, corner, x + dx AS x, y + dy AS y, z FROM ch CROSS JOIN o""")
def src_obj(t):
    """Files with a square at each chunk point: four vertices and a face of four corners, which is read as two triangles."""
    k = c("point_idx") / 10
    vertices = [F.concat_ws(" ", F.lit("v"), (c("x") + dx).cast("string"), (c("y") + dy).cast("string"), c("z").cast("string")) for dx, dy in _CORNERS]
    face = F.concat_ws(" ", F.lit("f"), *[(k * 4 + j).cast("long").cast("string") for j in range(1, 5)])
    rows = t.chunk_points.select("tile_id", "point_idx", F.array(*vertices, face).alias("some"))
    body = rows.groupBy("tile_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("point_idx", "some")))["some"]).alias("l"))
    found = text.obj(exploded(body.select(F.concat(F.lit("f"), c("tile_id").cast("string")).alias("path"), "l"), ["# squares"]))
    return found.select(TILE(), c("triangle").cast("long").alias("triangle"), "corner", *"xyz")


@query("src_patch_csv", "SELECT tile_id, point_idx, x, y, z FROM ch")
def src_patch_csv(t):
    rows = t.chunk_points.select(F.concat_ws(",", *[c(k).cast("string") for k in ("tile_id", "point_idx", *"xyz")]).alias("line"))
    return rows.select(F.from_csv("line", "tile_id bigint, point_idx bigint, x double, y double, z double").alias("s")).select("s.*")


@query("snk_chunk_csv", "SELECT concat_ws(', ', " + ", ".join(f"(({a}i + 5) // 100) || '.' || (({a}i + 5) // 10 % 10)" for a in "xyz") + ", r, g, b, 255) AS line FROM ch")
def snk_chunk_csv(t):
    return t.chunk_points.select(sinks.point_line().alias("line"))


_REPORT = "format('{:.2f} {:.2f} {:.2f} {:.2f} {:.2f} {:.2f}', min_x, min_y, min_z, max_x, max_y, max_z)"


@query("snk_tile_report", f"SELECT tile_id, {_REPORT} || '; ' || s AS line FROM tiles JOIN (SELECT tile_id, string_agg(format('{{:.2f}} {{:.2f}} {{:.2f}}', x, y, z), ', ' ORDER BY point_idx) AS s FROM pts WHERE point_idx % 50 = 0 GROUP BY tile_id) q USING (tile_id)")
def snk_tile_report(t):
    return sinks.tile_report(t.points, t.tiles, 50)


@query("snk_tile_report2", f"SELECT tile_id, {_REPORT} || '; ' || s AS line FROM tiles JOIN (SELECT tile_id, string_agg(format('{{:.2f}} {{:.2f}} {{:.2f}}', x, y, z), ', ' ORDER BY point_idx) AS s FROM pts WHERE point_idx % 100 = 0 GROUP BY tile_id) q USING (tile_id)")
def snk_tile_report2(t):
    return sinks.tile_report(t.points, t.tiles, 100)


@query("snk_simlod", "SELECT tile_id, point_idx, CAST(x - min_x AS FLOAT) AS x, CAST(y - min_y AS FLOAT) AS y, CAST(z - min_z AS FLOAT) AS z, r, g, b, 255 AS a FROM pts JOIN tiles USING (tile_id)")
def snk_simlod(t):
    """The files' points, read back."""
    return sinks.read_xyzrgba(sinks.xyzrgba(t.points, t.tiles)).select(TILE(), c("n").alias("point_idx"), *"xyzrgba")


@query("snk_heightmap", """h AS (SELECT CAST(floor(lx / 10e0) AS INT) AS ix, CAST(floor(ly / 10e0) AS INT) AS iy, CAST(greatest(max(z), 0e0) AS FLOAT) AS height FROM loc GROUP BY 1, 2)
 ;; SELECT ix, iy, height, CAST(trunc(height * CAST(10 AS FLOAT)) AS INT) AS grey FROM h WHERE height > 0""")
def snk_heightmap(t):
    """The files' pixels above 0, read back: heights and greys."""
    return sinks.read_height_files(sinks.height_files(raster.highest(t.placed(t.points))), above=0.0)


@query("snk_debug_patch", "SELECT px, py, count(*) AS lines, md5(string_agg(concat_ws(',', x, y, z, r, g, b), chr(10) ORDER BY tile_id, point_idx)) AS content FROM chl GROUP BY px, py")
def snk_debug_patch(t):
    """A patch's samples as CSV; a patch has few."""
    lines = t.placed(t.chunk_points).select("px", "py", F.struct("tile_id", "point_idx", F.to_csv(F.struct(*"xyzrgb")).alias("line")).alias("s"))
    return lines.groupBy("px", "py").agg(F.count("s").alias("lines"), F.md5(F.array_join(F.sort_array(F.collect_list("s"))["line"], "\n")).alias("content"))


@query("snk_stl")
def snk_stl(t):
    return sinks.mesh_files(contexts(t)).select("path", F.octet_length("content").alias("bytes"))


@query("snk_png", """p AS (SELECT tile_id % 32 AS ix, tile_id // 32 % 32 AS iy, CAST(max(r) AS INT) AS r, CAST(max(g) AS INT) AS g, CAST(max(b) AS INT) AS b FROM pts GROUP BY 1, 2)
 ;; SELECT ix, iy, r, g, b FROM p WHERE r + g + b > 0""")
def snk_png(t):
    """A picture of tiles as a PNG, its pixels that aren't black read back."""
    pixels = t.points.groupBy((c("tile_id") % 32).alias("ix"), F.floor(c("tile_id") / 32 % 32).alias("iy")).agg(*[F.max(a).alias(a) for a in "rgb"])
    return sinks.read_png(sinks.pictures(pixels.withColumn("path", F.lit("tiles.png")), 32, 32)).select("ix", "iy", *"rgb").filter("r + g + b > 0")
