"""Projections, filters, predicates, scalar functions and samples."""

from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import grid, raster
from geolode.plans.registry import number, query

c = F.col
KEY = ("tile_id", "point_idx")


@query("prj_dequant", "SELECT tile_id, point_idx, x, y, z FROM pts")
def prj_dequant(t):
    return t.points.select(*KEY, *[C.dequantised(c(f"{a}i"), 0.01).alias(a) for a in "xyz"])


@query("prj_rgb16to8", "SELECT tile_id, point_idx, r, g, b FROM pts")
def prj_rgb16to8(t):
    return t.points.select(*KEY, *[C.colour8(c(f"{a}16")).alias(a) for a in "rgb"])


@query("prj_local", "SELECT tile_id, point_idx, lx, ly, lz FROM loc")
def prj_local(t):
    return t.placed(t.points).select(*KEY, "lx", "ly", "lz")


@query("prj_patch_key", "SELECT tile_id, point_idx, px, py FROM loc")
def prj_patch_key(t):
    return t.placed(t.points).select(*KEY, "px", "py")


_SECTOR = "CASE WHEN l{a} - p{a} * 640e0 <= 160e0 THEN 0 WHEN l{a} - p{a} * 640e0 < 480e0 THEN 1 ELSE 2 END"


@query("prj_sector", f"SELECT tile_id, point_idx, {_SECTOR.format(a='x')} AS sx, {_SECTOR.format(a='y')} AS sy FROM loc")
def prj_sector(t):
    return t.placed(t.points).select(*KEY, *[C.sector(c(f"l{a}"), C.patch_edge(c(f"p{a}"))).alias(f"s{a}") for a in "xy"])


_TEXEL = "CAST(floor((l{a} + 5e0) / 10e0) AS INT)"


@query("prj_texel", f"SELECT tile_id, point_idx, {', '.join(f'{_TEXEL.format(a=a)} // 64 AS p{a}, {_TEXEL.format(a=a)} % 64 AS t{a}' for a in 'xy')} FROM loc")
def prj_texel(t):
    at = t.placed(t.points).drop("px", "py").withColumns({f"g{a}": C.texel(c(f"l{a}")) for a in "xy"})
    return at.select(*KEY, *[e for a in "xy" for e in (F.floor(c(f"g{a}") / C.TEXELS).cast("int").alias(f"p{a}"), F.pmod(c(f"g{a}"), F.lit(C.TEXELS)).alias(f"t{a}"))])


@query("prj_patch_bounds", "SELECT DISTINCT px, py, px * 640e0 AS min_x, py * 640e0 AS min_y, (px + 0.5e0) * 640e0 AS mid_x, (py + 0.5e0) * 640e0 AS mid_y, (px + 1) * 640e0 AS max_x, (py + 1) * 640e0 AS max_y FROM chl")
def prj_patch_bounds(t):
    return t.placed(t.chunk_points).select("px", "py").distinct().select("px", "py", *[C.patch_edge(c(f"p{a}"), k).alias(f"{n}_{a}") for n, k in (("min", 0.0), ("mid", 0.5), ("max", 1.0)) for a in "xy"])


@query("prj_n_patches", "SELECT CAST(ceil(size_x / 640e0) + 1 AS INT) AS nx, CAST(ceil(size_y / 640e0) + 1 AS INT) AS ny FROM world")
def prj_n_patches(t):
    return t.world.select(C.patch_count(c("size_x")).alias("nx"), C.patch_count(c("size_y")).alias("ny"))


@query("prj_n_chunks", "SELECT tile_id, k AS chunk_idx, least(n_points - k * 10, 10) AS n FROM (SELECT tile_id, n_points, unnest(range(0, (n_points + 9) // 10)) AS k FROM tiles) q")
def prj_n_chunks(t):
    chunks = t.tiles.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), C.chunk_count(c("n_points"), 10) - 1)))
    return chunks.select("tile_id", "chunk_idx", F.least(c("n_points") - c("chunk_idx") * 10, F.lit(10).cast("long")).alias("n"))


_R, _S, _O = number(C.RADIUS), number(C.STRETCH), number(C.RADIUS_OUT)


@query("prj_normalize", f"SELECT tile_id, point_idx, (lx - (px + 0.5e0) * 640e0) / {_R} * {_S} AS nx, (ly - (py + 0.5e0) * 640e0) / {_R} * {_S} AS ny, (lz - 25e0) / {_R} * 10e0 AS nz FROM loc")
def prj_normalize(t):
    at = t.placed(t.points)
    return at.select(*KEY, *[C.normalised(c(f"l{a}"), C.patch_edge(c(f"p{a}"), 0.5)).alias(f"n{a}") for a in "xy"], C.normalised_height(c("lz"), F.lit(25.0)).alias("nz"))


@query("prj_normalize_plain", f"SELECT tile_id, point_idx, (lx - (px + 0.5e0) * 640e0) / {_R} * 1e0 AS nx, (ly - (py + 0.5e0) * 640e0) / {_R} * 1e0 AS ny FROM loc")
def prj_normalize_plain(t):
    return t.placed(t.points).select(*KEY, *[C.normalised(c(f"l{a}"), C.patch_edge(c(f"p{a}"), 0.5), 1.0).alias(f"n{a}") for a in "xy"])


@query("prj_denormalize", f"SELECT tile_id, point_idx, (lz - 25e0) / {_R} * 10e0 / 10e0 * {_O} + 25e0 AS h FROM loc")
def prj_denormalize(t):
    return t.placed(t.points).select(*KEY, C.denormalised_height(C.normalised_height(c("lz"), F.lit(25.0)), F.lit(25.0)).alias("h"))


@query("prj_rgb_float", "SELECT tile_id, point_idx, r / 256e0 AS r, g / 256e0 AS g, b / 256e0 AS b FROM pts")
def prj_rgb_float(t):
    return t.points.select(*KEY, *[(c(a) / 256.0).alias(a) for a in "rgb"])


# a raster of texels with a mask: every seventh has none
_MASK = "tex AS (SELECT DISTINCT px, py, ((xi + yi) % 64) AS tx, ((xi * 7 + yi * 3) % 64) AS ty FROM chl), mask AS (SELECT *, CASE WHEN (tx * 5 + ty * 3 + px) % 7 = 0 THEN -1 ELSE 1 END AS m FROM tex)"


def masked(t):
    tex = t.placed(t.chunk_points).select("px", "py", F.pmod(c("xi") + c("yi"), F.lit(64)).cast("int").alias("tx"), F.pmod(c("xi") * 7 + c("yi") * 3, F.lit(64)).cast("int").alias("ty")).distinct()
    return tex.withColumn("m", F.when((c("tx") * 5 + c("ty") * 3 + c("px")) % 7 == 0, -1).otherwise(1))


@query("prj_mask_color", _MASK + """;; SELECT a.px, a.py, a.tx, a.ty, CASE WHEN bool_or(b.m < 0) THEN 0::BIGINT ELSE CAST(a.tx AS BIGINT) + a.ty * 256 + 255 * 16777216::BIGINT END AS colour
  FROM mask a JOIN mask b ON a.px = b.px AND a.py = b.py AND abs(a.tx - b.tx) <= 1 AND abs(a.ty - b.ty) <= 1 GROUP BY a.px, a.py, a.tx, a.ty""")
def prj_mask_color(t):
    mask = masked(t)
    near = grid.with_neighbours(mask, "tx", "ty", ("nx", "ny")).select("px", "py", c("nx").alias("tx"), c("ny").alias("ty"), c("m").alias("beside"))
    bad = mask.join(near, ["px", "py", "tx", "ty"]).groupBy("px", "py", "tx", "ty").agg(F.bool_or(c("beside") < 0).alias("bad"))
    return bad.select("px", "py", "tx", "ty", F.when(c("bad"), F.lit(0).cast("long")).otherwise(C.packed(c("tx"), c("ty"), F.lit(0))).alias("colour"))


@query("prj_mask_color64", _MASK + ";; SELECT px, py, tx, ty, CASE WHEN m < 0 THEN 0::BIGINT ELSE CAST(tx AS BIGINT) * 256 + CAST(ty AS BIGINT) * 256 * 65536 END AS colour FROM mask")
def prj_mask_color64(t):
    wide = c("tx").cast("long") * 256 + c("ty").cast("long") * 256 * 65536
    return masked(t).select("px", "py", "tx", "ty", F.when(c("m") < 0, F.lit(0).cast("long")).otherwise(wide).alias("colour"))


@query("prj_index_color", "SELECT tile_id, ((tile_id % 127 + 1) * 12345678) % 4294967296 AS colour FROM tiles")
def prj_index_color(t):
    return t.tiles.select("tile_id", C.index_colour(c("tile_id")).alias("colour"))


@query("prj_packed_color", "SELECT tile_id, point_idx, CAST(r AS BIGINT) + g * 256 + b * 65536 + 255 * 16777216::BIGINT AS colour FROM pts")
def prj_packed_color(t):
    return t.points.select(*KEY, C.packed(c("r"), c("g"), c("b")).alias("colour"))


_RASTER = "rast AS (SELECT CAST(floor(lx / 20e0) AS INT) AS ix, CAST(floor(ly / 20e0) AS INT) AS iy, max(z) AS h FROM loc GROUP BY 1, 2)"


def raster20(t):
    return t.placed(t.points).groupBy(C.cell(c("lx"), 20.0).alias("ix"), C.cell(c("ly"), 20.0).alias("iy")).agg(F.max("z").alias("h"))


@query("prj_normal", _RASTER + """;; SELECT ix, iy, round(-dx / l, 6) AS nx, round(-dy / l, 6) AS ny, round(40e0 / l, 6) AS nz FROM (SELECT *, sqrt(dx * dx + dy * dy + 1600e0) AS l FROM (
  SELECT a.ix, a.iy, e.h - w.h AS dx, n.h - s.h AS dy FROM rast a JOIN rast e ON e.ix = a.ix + 1 AND e.iy = a.iy JOIN rast w ON w.ix = a.ix - 1 AND w.iy = a.iy
  JOIN rast n ON n.ix = a.ix AND n.iy = a.iy + 1 JOIN rast s ON s.ix = a.ix AND s.iy = a.iy - 1) q) q""")
def prj_normal(t):
    df = raster.steps(raster20(t)).withColumn("l", F.sqrt(c("dx") * c("dx") + c("dy") * c("dy") + 1600.0))
    # negated after rounding, which drops the sign of zero: a level side gives -0.0, as in SQL
    return df.select("ix", "iy", *[(-F.round(c(f"d{a}") / c("l"), 6)).alias(f"n{a}") for a in "xy"], F.round(F.lit(40.0) / c("l"), 6).alias("nz"))


_WHOLE = "((0e0 - 1000e0) * (0e0 - 0e0) + (0e0 - 1000e0) * (0e0 - 1000e0) + 1e-5)"


@query("prj_bary", f"""SELECT tile_id, point_idx, round(a, 9) AS a, round(b, 9) AS b, round(1 - a - b, 9) AS c FROM (SELECT tile_id, point_idx,
  ((0e0 - 1000e0) * (x - 0e0) + (0e0 - 1000e0) * (y - 1000e0)) / {_WHOLE} AS a, ((1000e0 - 0e0) * (x - 0e0) + (0e0 - 0e0) * (y - 1000e0)) / {_WHOLE} AS b FROM ch) q""")
def prj_bary(t):
    corners = [F.lit(v) for v in (0.0, 0.0, 1000.0, 0.0, 0.0, 1000.0)]
    return t.chunk_points.select(*KEY, *[F.round(w, 9).alias(n) for n, w in zip("abc", C.barycentric(c("x"), c("y"), *corners), strict=True)])


@query("prj_circumcircle", """SELECT tile_id, point_idx, round(cx, 4) AS cx, round(cy, 4) AS cy FROM (SELECT tile_id, point_idx, d,
   CASE WHEN abs(d) >= 1e-12 THEN (0e0 * (100e0 - y) + 10000e0 * (y - 0e0) + (x * x + y * y) * (0e0 - 100e0)) / d END AS cx,
   CASE WHEN abs(d) >= 1e-12 THEN (0e0 * (x - 0e0) + 10000e0 * (0e0 - x) + (x * x + y * y) * (0e0 - 0e0)) / d END AS cy
   FROM (SELECT tile_id, point_idx, x, y, 2e0 * (0e0 * (100e0 - y) + 0e0 * (y - 0e0) + x * (0e0 - 100e0)) AS d FROM ch) q) q""")
def prj_circumcircle(t):
    cx, cy, _ = C.circumcircle(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(100.0), c("x"), c("y"))
    return t.chunk_points.select(*KEY, F.round(cx, 4).alias("cx"), F.round(cy, 4).alias("cy"))


@query("prj_grid_id", "SELECT tile_id, point_idx, CAST(greatest(0, least(95, floor(lx / 100e0))) AS INT) + 96 * CAST(greatest(0, least(95, floor(ly / 100e0))) AS INT) AS id FROM loc")
def prj_grid_id(t):
    i, j = (F.greatest(F.lit(0), F.least(F.lit(95), C.cell(c(f"l{a}"), 100.0))) for a in "xy")
    return t.placed(t.points).select(*KEY, (i + 96 * j).alias("id"))


@query("prj_smoothstep", "SELECT event_id, u * u * (3e0 - 2e0 * u) AS s, 10e0 + (20e0 - 10e0) * u AS l FROM (SELECT event_id, (event_id % 100) / 100e0 AS u FROM events) q")
def prj_smoothstep(t):
    u = c("event_id") % 100 / 100.0
    return t.read("events").select("event_id", C.smoothstep(u).alias("s"), C.lerp(F.lit(10.0), F.lit(20.0), u).alias("l"))


@query("prj_gauss", f"SELECT event_id, round(exp(-0.5e0 * ((u - 50e0) / 12e0) * ((u - 50e0) / 12e0)) / {number(12 * (2 * 3.1415) ** 0.5)}, 9) AS p FROM (SELECT event_id, CAST(event_id % 100 AS DOUBLE) AS u FROM events) q")
def prj_gauss(t):
    return t.read("events").select("event_id", F.round(C.gauss((c("event_id") % 100).cast("double"), 50.0, 12.0), 9).alias("p"))


def _ramp_sql(k):
    levels = "[" + ", ".join(f"{v[k]}e0" for v in C.RAMP) + "]"
    return f"CAST(floor({levels}[i + 1] + ({levels}[i + 2] - {levels}[i + 1]) * (u - i)) AS INT)"


@query("prj_gradient", f"SELECT tile_id, point_idx, {', '.join(f'{_ramp_sql(k)} AS {n}' for k, n in enumerate('rgb'))} FROM (SELECT tile_id, point_idx, u, CAST(least(floor(u), 9) AS INT) AS i FROM (SELECT tile_id, point_idx, greatest(0e0, least(1e0, z / 51e0)) * 10e0 AS u FROM pts) q) q")
def prj_gradient(t):
    return t.points.select(*KEY, *[C.ramp(c("z") / 51.0, k).alias(n) for k, n in enumerate("rgb")])


@query("prj_str", "SELECT p_partkey, ends_with(lower(p_name), 'e') AS ends, string_split(p_type, ' ')[1] AS first, lpad(CAST(p_size AS VARCHAR), 5, '0') AS padded, replace(p_brand, '#', '-') AS swapped, repeat('=', 3) AS line FROM part")
def prj_str(t):
    return t.read("part").select("p_partkey", F.lower("p_name").endswith("e").alias("ends"), F.split("p_type", " ")[0].alias("first"), F.lpad(c("p_size").cast("string"), 5, "0").alias("padded"), F.replace("p_brand", F.lit("#"), F.lit("-")).alias("swapped"), F.repeat(F.lit("="), 3).alias("line"))


@query("prj_thousands", "SELECT o_orderkey, format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) AS n FROM orders")
def prj_thousands(t):
    return t.read("orders").select("o_orderkey", F.format_number(F.floor("o_totalprice"), 0).alias("n"))


@query("prj_roundup", "SELECT tile_id, CAST(ceil(n_points / 4096e0) * 4096 AS BIGINT) AS n FROM tiles")
def prj_roundup(t):
    return t.tiles.select("tile_id", C.round_up(c("n_points"), 4096).alias("n"))


@query("prj_shift_scale", "SELECT p.tile_id, point_idx, (x - lo) / 500e0 AS sx, r / 256e0 AS sr FROM pts p JOIN (SELECT tile_id, min(x) AS lo FROM pts WHERE point_idx % 100 = 0 GROUP BY tile_id) m ON p.tile_id = m.tile_id")
def prj_shift_scale(t):
    low = grid.every(t.points, "point_idx", 100).groupBy("tile_id").agg(F.min("x").alias("lo"))
    return t.points.join(low, "tile_id").select(*KEY, ((c("x") - c("lo")) / 500.0).alias("sx"), (c("r") / 256.0).alias("sr"))


@query("prj_focus", "SELECT tile_id, (min_x + max_x) * 0.5e0 AS cx, (min_y + max_y) * 0.5e0 AS cy, (min_z + max_z) * 0.5e0 AS cz, round(1.2e0 * sqrt((max_x - min_x) * (max_x - min_x) + (max_y - min_y) * (max_y - min_y) + (max_z - min_z) * (max_z - min_z)), 6) AS radius FROM tiles")
def prj_focus(t):
    size = {a: c(f"max_{a}") - c(f"min_{a}") for a in "xyz"}
    diagonal = F.sqrt(size["x"] * size["x"] + size["y"] * size["y"] + size["z"] * size["z"])
    return t.tiles.select("tile_id", *[((c(f"min_{a}") + c(f"max_{a}")) * 0.5).alias(f"c{a}") for a in "xyz"], F.round(1.2 * diagonal, 6).alias("radius"))


@query("flt_aabb3", "SELECT tile_id, point_idx FROM pts WHERE x >= 500 AND x <= 4500 AND y >= 100 AND y <= 900 AND z >= 10 AND z <= 40")
def flt_aabb3(t):
    box = [[F.lit(v) for v in s] for s in ((500.0, 100.0, 10.0), (4500.0, 900.0, 40.0))]
    return t.points.filter(C.inside([c(a) for a in "xyz"], *box)).select(*KEY)


@query("flt_aabb2", "SELECT tile_id FROM tiles WHERE min_x <= 4500 AND 500 <= max_x AND min_y <= 900 AND 100 <= max_y")
def flt_aabb2(t):
    low, high = ([c(f"{n}_{a}") for a in "xy"] for n in ("min", "max"))
    return t.tiles.filter(C.overlaps(low, high, [F.lit(500.0), F.lit(100.0)], [F.lit(4500.0), F.lit(900.0)])).select("tile_id")


@query("flt_suspicious", "SELECT tile_id, max_z FROM tiles WHERE max_z * 160 > 8000")
def flt_suspicious(t):
    from geolode.operators.lod import SUSPICIOUS_HEIGHT

    return t.tiles.filter(c("max_z") * 160 > SUSPICIOUS_HEIGHT).select("tile_id", "max_z")


@query("flt_min_samples", "SELECT px, py, count(*) AS n, count(*) >= 25 AS enough FROM chl GROUP BY px, py")
def flt_min_samples(t):
    from geolode.operators.heightmap import LEAST_SAMPLES

    return t.placed(t.chunk_points).groupBy("px", "py").agg(F.count("*").alias("n")).withColumn("enough", c("n") >= LEAST_SAMPLES)


@query("flt_debug_patch", "SELECT tile_id, point_idx, lx, ly FROM chl WHERE px = 3 AND py = 1")
def flt_debug_patch(t):
    return t.placed(t.chunk_points).filter("px = 3 AND py = 1").select(*KEY, "lx", "ly")


@query("smp_chunk", "SELECT tile_id, point_idx, x, y, z, r, g, b FROM ch")
def smp_chunk(t):
    return grid.every(t.points, "point_idx", 10).select(*KEY, *"xyzrgb")


@query("smp_every_k", "SELECT tile_id, point_idx FROM pts WHERE point_idx % 100 = 0")
def smp_every_k(t):
    return grid.every(t.points, "point_idx", 100).select(*KEY)


@query("smp_voxel", """key AS (SELECT *, CAST(floor(x / 320e0) AS INT) AS vx, CAST(floor(y / 320e0) AS INT) AS vy, CAST(floor(z / 320e0) AS INT) AS vz FROM ch),
 mid AS (SELECT vx, vy, vz, count(*) AS n, sum(xi) / count(*) * 1e-2 AS cx, sum(yi) / count(*) * 1e-2 AS cy, sum(zi) / count(*) * 1e-2 AS cz FROM key GROUP BY vx, vy, vz)
 ;; SELECT vx, vy, vz, n, tile_id, point_idx FROM (SELECT vx, vy, vz, n, tile_id, point_idx, row_number() OVER (PARTITION BY vx, vy, vz ORDER BY round(0e0 + (x - cx) * (x - cx) + (y - cy) * (y - cy) + (z - cz) * (z - cz), 6), tile_id, point_idx) AS k
 FROM key JOIN mid USING (vx, vy, vz)) q WHERE k = 1""")
def smp_voxel(t):
    return grid.voxel_sample(t.chunk_points, 320.0)


_SIDE = "greatest(size_x, size_y, size_z)"


@query("smp_voxel_occ", f"SELECT DISTINCT {', '.join(f'CAST(least(floor(({a} - origin_{a}) / {_SIDE} * 32e0), 31) AS INT) AS v{a}' for a in 'xyz')} FROM pts CROSS JOIN world")
def smp_voxel_occ(t):
    at = t.points.join(F.broadcast(t.world.withColumn("side", F.greatest("size_x", "size_y", "size_z"))))
    return at.select(*[F.least(F.floor((c(a) - c(f"origin_{a}")) / c("side") * 32.0), F.lit(31)).cast("int").alias(f"v{a}") for a in "xyz"]).distinct()


@query("smp_random", "SELECT tile_id, " + ", ".join(f"CAST(('0x' || substr(md5(tile_id || ':{k}'), 1, 8)) AS BIGINT) / 4294967296e0 AS {a}" for k, a in enumerate("xyz")) + " FROM tiles")
def smp_random(t):
    """Numbers from 0 to 1 that hang on the key alone, so they are the same however the rows are dealt."""
    return t.tiles.select("tile_id", *[grid.uniform(c("tile_id"), k).alias(a) for k, a in enumerate("xyz")])
