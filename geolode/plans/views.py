"""View queries: what a camera sees, and the pictures it gives. The camera is a parameter, so it becomes literals in the plan."""

from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.functions.camera import Camera
from geolode.operators import aggregate, heightmap, lod, mesh_raster, raster
from geolode.plans import storage
from geolode.plans.aggregations import agg_texture
from geolode.plans.joins import _PATCHES, chunk_state, contexts, patches
from geolode.plans.registry import number as n
from geolode.plans.registry import query

c = F.col
CAMERA = Camera()
KEY = ("tile_id", "point_idx")


def clip_sql(x, y, z):
    return [f"({n(m[0])} * {x} + {n(m[1])} * {y} + {n(m[2])} * {z} + {n(m[3])})" for m in CAMERA.matrix]


def screen_sql(x, y, z):
    cx, cy, _, w = clip_sql(x, y, z)
    return [f"(({cx} / {w} * 0.5e0 + 0.5e0) * {n(CAMERA.width)})", f"(({cy} / {w} * 0.5e0 + 0.5e0) * {n(CAMERA.height)})", w]


def planes_sql(low, high, flat=False):
    tests = []
    for p in CAMERA.planes:
        terms = [f"{n(p[k])} * {(high if p[k] > 0 else low)[k]}" for k in range(2 if flat else 3)]
        tests.append(f"({' + '.join(terms)} + {n(p[3])} >= 0)")
    return " AND ".join(tests)


LOW, HIGH = ([f"{k}_{a}" for a in "xyz"] for k in ("min", "max"))
_CORNERS = [screen_sql(*[(HIGH if k >> d & 1 else LOW)[d] for d in range(3)]) for k in range(8)]
_BOX = [f"{f}({', '.join(p[a] for p in _CORNERS)})" for f, a in (("least", 0), ("least", 1), ("greatest", 0), ("greatest", 1))]
_MID = [f"((min_{a} + max_{a}) * 0.5e0)" for a in "xyz"]


def distance_sql(x, y, z):
    cx, cy, _, w = clip_sql(x, y, z)
    return f"sqrt(({cx} / {w}) * ({cx} / {w}) + ({cy} / {w}) * ({cy} / {w}))"


_D = distance_sql(*_MID)
_SIZE = f"(greatest(0.1e0, least(1e0, exp(-({_D} * {_D}) / 0.04e0))) * ({_BOX[2]} - {_BOX[0]}) * ({_BOX[3]} - {_BOX[1]}))"
_WEIGHT = f"({_SIZE} * greatest(0e0, least(1e0, 1e0 - {_D})) / greatest(0.1e0, least(10e0, n_points / 1e6)))"
_SEEN = planes_sql(LOW, HIGH)
_TILES = f"wt AS (SELECT *, CASE WHEN visible THEN round({_WEIGHT}, 6) ELSE 0e0 END AS weight FROM (SELECT *, {_SEEN} AS visible FROM tiles) q)"


def low_high():
    return ([c(k) for k in LOW], [c(k) for k in HIGH])


@query("prj_project", f"SELECT tile_id, point_idx, round(fx, 3) AS fx, round(fy, 3) AS fy, round(w, 3) AS w FROM (SELECT tile_id, point_idx, {', '.join(f'{e} AS {k}' for e, k in zip(screen_sql('x', 'y', 'z'), ('fx', 'fy', 'w')))} FROM ch) q")
def prj_project(t):
    return t.chunk_points.select(*KEY, *[F.round(e, 3).alias(k) for e, k in zip(CAMERA.screen(c("x"), c("y"), c("z")), ("fx", "fy", "w"), strict=True)])


@query("prj_screen_bbox", f"SELECT tile_id, {', '.join(f'round({e}, 3) AS {k}' for e, k in zip(_BOX, ('x0', 'y0', 'x1', 'y1')))} FROM tiles")
def prj_screen_bbox(t):
    return t.tiles.select("tile_id", *[F.round(e, 3).alias(k) for e, k in zip(CAMERA.screen_box(*low_high()), ("x0", "y0", "x1", "y1"), strict=True)])


@query("prj_screen_size", f"SELECT tile_id, round({_SIZE}, 4) AS size FROM tiles")
def prj_screen_size(t):
    return t.tiles.select("tile_id", F.round(CAMERA.size_on_screen(*low_high()), 4).alias("size"))


@query("prj_tile_weight", _TILES + ";; SELECT tile_id, round(weight, 4) AS weight FROM wt")
def prj_tile_weight(t):
    return lod.weigh_tiles(t.tiles, CAMERA).select("tile_id", F.round("weight", 4).alias("weight"))


_PX, _PY = "((px + 0.5e0) * 640e0)", "((py + 0.5e0) * 640e0)"
_TASK = f"CASE WHEN {clip_sql(_PX, _PY, '25e0')[3]} < 0 THEN 0e0 ELSE greatest(0e0, least(1e0, 1e0 - {distance_sql(_PX, _PY, '25e0')})) / {clip_sql(_PX, _PY, '25e0')[3]} END"


def task_weight():
    return F.round(CAMERA.task_weight(C.patch_edge(c("px"), 0.5), C.patch_edge(c("py"), 0.5), F.lit(25.0)), 9)


@query("prj_task_weight", f"{_PATCHES};; SELECT px, py, round({_TASK}, 9) AS weight FROM patches")
def prj_task_weight(t):
    return patches(t).select("px", "py", task_weight().alias("weight"))


@query("srt_tasks", f"{_PATCHES};; SELECT px, py, CAST(row_number() OVER (ORDER BY round({_TASK}, 9) DESC, px, py) AS INT) AS place FROM patches")
def srt_tasks(t):
    weighed = patches(t).select("px", "py", task_weight().alias("weight"))
    return storage.placed_in_order(weighed, F.desc("weight"), "px", "py").select("px", "py", c("place").cast("int").alias("place"))


@query("prj_tri_screen", f"SELECT tile_id, {', '.join(f'round({e}, 3) AS {k}{v}' for v in range(2) for e, k in zip(screen_sql(*[(LOW, HIGH)[v][d] for d in range(3)]), 'xyw'))} FROM tiles")
def prj_tri_screen(t):
    return t.tiles.select("tile_id", *[F.round(e, 3).alias(f"{k}{v}") for v, box in enumerate(low_high()) for e, k in zip(CAMERA.screen(*box), "xyw", strict=True)])


@query("flt_frustum3", f"SELECT tile_id FROM tiles WHERE {_SEEN}")
def flt_frustum3(t):
    return t.tiles.filter(CAMERA.sees_box(*low_high())).select("tile_id")


@query("flt_frustum2", f"SELECT tile_id FROM tiles WHERE {planes_sql(LOW, HIGH, True)}")
def flt_frustum2(t):
    return t.tiles.filter(CAMERA.sees_box(*low_high(), flat=True)).select("tile_id")


@query("flt_frustum_point", f"SELECT tile_id, point_idx FROM pts WHERE {planes_sql('xyz', 'xyz')}")
def flt_frustum_point(t):
    return t.points.filter(CAMERA.sees_point(c("x"), c("y"), c("z"))).select(*KEY)


_PIC = f"fx >= 2 AND fx <= {CAMERA.width - 3} AND fy >= 2 AND fy <= {CAMERA.height - 3} AND w > 0"
_FRAG = f"fr AS (SELECT CAST(floor(fx) AS INT) AS ix, CAST(floor(fy) AS INT) AS iy, round(w, 3) AS depth, colour, r, g, b FROM (SELECT {', '.join(f'{e} AS {k}' for e, k in zip(screen_sql('x', 'y', 'z'), ('fx', 'fy', 'w')))}, CAST(r AS BIGINT) + g * 256 + b * 65536 + 255 * 16777216::BIGINT AS colour, r, g, b FROM pts) q WHERE {_PIC})"


def fragments(t):
    return raster.point_fragments(t.points, CAMERA, C.packed(c("r"), c("g"), c("b")))


@query("flt_screen", _FRAG + ";; SELECT ix, iy, count(*) AS n FROM fr GROUP BY ix, iy")
def flt_screen(t):
    return fragments(t).groupBy("ix", "iy").agg(F.count("*").alias("n"))


@query("flt_highly_visible", _TILES + ";; SELECT tile_id FROM wt WHERE weight > 10000")
def flt_highly_visible(t):
    return lod.weigh_tiles(t.tiles, CAMERA).filter("is_highly_visible").select("tile_id")


@query("agg_zbuffer", _FRAG + ";; SELECT ix, iy, depth, colour FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY depth, colour) AS k FROM fr) q WHERE k = 1")
def agg_zbuffer(t):
    return aggregate.depth_buffer(fragments(t))


@query("agg_hq_depth", _FRAG + ";; SELECT ix, iy, min(depth) AS depth FROM fr GROUP BY ix, iy")
def agg_hq_depth(t):
    return fragments(t).groupBy("ix", "iy").agg(F.min("depth").alias("depth"))


@query("agg_hq_color", _FRAG + """;; SELECT ix, iy, CAST(floor(sum(r) / count(*)) AS INT) AS r, CAST(floor(sum(g) / count(*)) AS INT) AS g, CAST(floor(sum(b) / count(*)) AS INT) AS b, count(*) AS n
  FROM (SELECT *, min(depth) OVER (PARTITION BY ix, iy) AS front FROM fr) q WHERE depth < front * 1.01e0 GROUP BY ix, iy""")
def agg_hq_color(t):
    return aggregate.smooth_colours(fragments(t), CAMERA.width * CAMERA.height)


def edges(t):
    return raster.box_edges(t.tiles, *low_high()).withColumn("colour", C.index_colour(c("tile_id")))


def _corner_sql(k):
    return [(HIGH if k >> d & 1 else LOW)[d] for d in range(3)]


_EDGES = "ed AS (" + " UNION ALL ".join(f"SELECT tile_id, {k} AS edge, " + ", ".join(f"{e} AS {m}" for e, m in zip([*_corner_sql(a), *_corner_sql(b)], ("ax", "ay", "az", "bx", "b_y", "bz"))) + " FROM tiles" for k, (a, b) in enumerate(raster.EDGES)) + ")"


@query("geo_box_lines", _EDGES + ";; SELECT tile_id, edge, ax, ay, az, bx, b_y AS \"by\", bz FROM ed")
def geo_box_lines(t):
    return raster.box_edges(t.tiles, *low_high()).select("tile_id", "edge", "ax", "ay", "az", "bx", "by", "bz")


_BOXES = "bt AS (" + " UNION ALL ".join(f"SELECT tile_id, {k} AS triangle, " + ", ".join(f"{e} AS {a}{v}" for v, corner in enumerate(t) for a, e in zip("xyz", _corner_sql(corner))) + " FROM tiles" for k, t in enumerate(t for a, b, d, e in raster.SIDES for t in ((a, b, d), (a, d, e)))) + ")"


@query("geo_box_triangles", _BOXES + ";; SELECT * FROM bt")
def geo_box_triangles(t):
    return raster.box_triangles(t.tiles, *low_high()).select("tile_id", "triangle", *[f"{a}{v}" for v in range(3) for a in "xyz"])


_LINE = f"""ln_ AS (SELECT (tile_id % 127 + 1) * 12345678 % 4294967296 AS colour, {', '.join(f'{e} AS a{k}' for e, k in zip(screen_sql('ax', 'ay', 'az'), 'xyw'))}, {', '.join(f'{e} AS b{k}' for e, k in zip(screen_sql('bx', 'b_y', 'bz'), ('x', '_y', 'w')))} FROM ed),
 st AS (SELECT *, least(400, greatest(1, CAST(ceil(greatest(abs(bx - ax), abs(b_y - ay))) AS INT))) AS steps FROM ln_ WHERE aw > 0 AND bw > 0),
 lf AS (SELECT CAST(floor(fx) AS INT) AS ix, CAST(floor(fy) AS INT) AS iy, round(w, 3) AS depth, colour FROM (SELECT colour, ax + (bx - ax) * u AS fx, ay + (b_y - ay) * u AS fy, aw + (bw - aw) * u AS w FROM (
   SELECT *, k / CAST(steps AS DOUBLE) AS u FROM (SELECT *, unnest(range(0, steps + 1)) AS k FROM st) q) q) q WHERE {_PIC})"""


@query("agg_line_raster", _EDGES + ", " + _LINE + ";; SELECT ix, iy, depth, colour FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY depth, colour) AS k FROM lf) q WHERE k = 1")
def agg_line_raster(t):
    return aggregate.depth_buffer(raster.line_fragments(edges(t), CAMERA))


# triangles on the picture, from part and size keys, some of them turned away
_TRI = """tri AS (SELECT p_partkey AS id, CAST(p_partkey * 7 % 600 AS DOUBLE) AS sx0, CAST(p_partkey * 13 % 330 AS DOUBLE) AS sy0, 10e0 + p_partkey % 5 AS w0,
  CAST(p_partkey * 7 % 600 + 12 AS DOUBLE) AS sx1, CAST(p_partkey * 13 % 330 + p_size % 9 AS DOUBLE) AS sy1, 12e0 + p_partkey % 3 AS w1,
  CAST(p_partkey * 7 % 600 + p_size % 7 AS DOUBLE) AS sx2, CAST(p_partkey * 13 % 330 + 14 - p_size AS DOUBLE) AS sy2, 9e0 + p_partkey % 4 - CASE WHEN p_partkey % 50 = 0 THEN 20 ELSE 0 END AS w2 FROM part)"""


def triangles(t):
    k, s = c("p_partkey"), c("p_size")
    whole = {"id": k, "sx0": k * 7 % 600, "sy0": k * 13 % 330, "w0": 10.0 + k % 5, "sx1": k * 7 % 600 + 12, "sy1": k * 13 % 330 + s % 9, "w1": 12.0 + k % 3, "sx2": k * 7 % 600 + s % 7, "sy2": k * 13 % 330 + 14 - s, "w2": 9.0 + k % 4 - F.when(k % 50 == 0, 20).otherwise(0)}
    return t.read("part").select(*[(v if n == "id" else v.cast("double")).alias(n) for n, v in whole.items()])


_TURN = "(sx1 - sx0) * (sy2 - sy0) - (sy1 - sy0) * (sx2 - sx0) >= 0 AND least(w0, w1, w2) >= 0"


@query("flt_backface", f"{_TRI};; SELECT id FROM tri WHERE {_TURN}")
def flt_backface(t):
    turn = (c("sx1") - c("sx0")) * (c("sy2") - c("sy0")) - (c("sy1") - c("sy0")) * (c("sx2") - c("sx0"))
    return triangles(t).filter((turn >= 0) & (F.least("w0", "w1", "w2") >= 0)).select("id")


_MESH = f"""ready AS (SELECT px, py FROM patches WHERE n >= 25), hm AS (SELECT CAST(floor(lx / 10e0) AS INT) AS gx, CAST(floor(ly / 10e0) AS INT) AS gy, greatest(max(z), 0e0) AS h FROM loc GROUP BY 1, 2),
 hr AS (SELECT hm.* FROM hm JOIN ready ON px = gx // 64 AND py = gy // 64),
 sq AS (SELECT px, py, px * 64 + i AS gx, py * 64 + j AS gy FROM (SELECT px, py, i, unnest(range(64))::INT AS j FROM (SELECT px, py, unnest(range(64))::INT AS i FROM ready) q) q),
 vt AS (SELECT v.gx, v.gy, v.gx * 10e0 AS x, v.gy * 10e0 AS y, coalesce(h, 0e0) AS z FROM (SELECT DISTINCT gx + dx AS gx, gy + dy AS gy FROM sq, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(dx, dy)) v LEFT JOIN hr ON hr.gx = v.gx AND hr.gy = v.gy),
 sv AS (SELECT gx, gy, {', '.join(f'{e} AS {k}' for e, k in zip(screen_sql('x', 'y', 'z'), ('sx', 'sy', 'w')))} FROM vt),
 tri AS (SELECT (px * 31 + py * 17) % 256 AS colour, {', '.join(f'{k}.{f} AS {f}{n}' for n, k in enumerate('abc') for f in ('sx', 'sy', 'w'))}
   FROM sq, (VALUES (0, 0, 1, 0, 1, 1), (0, 0, 1, 1, 0, 1)) t(ax, ay, bx, b_y, cx, cy), sv a, sv b, sv c
   WHERE a.gx = sq.gx + t.ax AND a.gy = sq.gy + t.ay AND b.gx = sq.gx + t.bx AND b.gy = sq.gy + t.b_y AND c.gx = sq.gx + t.cx AND c.gy = sq.gy + t.cy),
 bx AS (SELECT *, CAST(floor(greatest(0, least({CAMERA.width}, least(sx0, sx1, sx2)))) AS INT) AS x0, CAST(ceil(greatest(0, least({CAMERA.width}, greatest(sx0, sx1, sx2)))) AS INT) AS x1,
   CAST(floor(greatest(0, least({CAMERA.height}, least(sy0, sy1, sy2)))) AS INT) AS y0, CAST(ceil(greatest(0, least({CAMERA.height}, greatest(sy0, sy1, sy2)))) AS INT) AS y1
   FROM tri WHERE w0 > 0 AND w1 > 0 AND w2 > 0 AND (sx1 - sx0) * (sy2 - sy0) - (sy1 - sy0) * (sx2 - sx0) > 0),
 fr AS (SELECT *, (sx1 - sx0) * (sy2 - sy0) - (sy1 - sy0) * (sx2 - sx0) AS d FROM (SELECT *, unnest(range(y0, y1))::INT AS iy FROM (SELECT *, unnest(range(x0, x1))::INT AS ix FROM bx) q) q),
 st AS (SELECT *, ((ix - sx0) * (sy2 - sy0) - (iy - sy0) * (sx2 - sx0)) / d AS s, ((sx1 - sx0) * (iy - sy0) - (sy1 - sy0) * (ix - sx0)) / d AS t FROM fr),
 tf AS (SELECT ix, iy, colour * 65793 AS colour, round(((1e0 - (s + t)) * w0 + s * w1 + t * w2) * 1.2e0 + 10e0, 3) AS depth FROM st WHERE s >= 0 AND t >= 0 AND 1e0 - (s + t) >= 0)"""


def in_view(t, df):
    """df (px, py and others) without the patches that give no pixel: neither they nor one beside them may lie on the picture, at any height of the world. The ones beside are kept for their edges."""
    name = f"{storage.without_clash(df)}top"
    top = t.world.select((F.greatest(c("origin_z") + c("size_z"), c("size_z")) + 1.0).alias(name))
    low, high = ([C.patch_edge(c("px"), at), C.patch_edge(c("py"), at), z] for at, z in ((-1.0, F.lit(-1.0)), (2.0, c(name))))
    return df.join(F.broadcast(top)).filter(CAMERA.may_show_box(low, high)).select(*df.columns)  # one row


def highest_maps(t):
    """Of each patch with enough chunk points, if it may be in view, its 64 x 64 greatest heights."""
    at = raster.highest(t.placed(t.points)).select(*[e for a in "xy" for e in (F.floor(c(f"i{a}") / C.TEXELS).cast("int").alias(f"p{a}"), F.pmod(c(f"i{a}"), F.lit(C.TEXELS)).alias(f"t{a}"))], "height")
    at = in_view(t, at)
    return in_view(t, patches(t).filter("n >= 25").select("px", "py")).join(mesh_raster.as_maps(at, "height", "double"), ["px", "py"], "left")


@query("agg_tri_raster", f"{_PATCHES}, {_MESH};; SELECT ix, iy, depth, CAST(colour AS BIGINT) AS colour FROM (SELECT *, row_number() OVER (PARTITION BY ix, iy ORDER BY depth, colour) AS k FROM tf) q WHERE k = 1")
def agg_tri_raster(t):
    """The triangles of the heightmaps of greatest heights, coloured by patch."""
    own = F.transform(F.sequence(F.lit(1), F.lit(C.TEXELS * C.TEXELS)), lambda _: ((c("px") * 31 + c("py") * 17) % 256 * 65793).cast("bigint"))
    maps = highest_maps(t).withColumn("colour", own)
    # a patch's far edges have its own colour: no mixing with the next one's
    return aggregate.depth_buffer(mesh_raster.fragments(storage.kept(maps), CAMERA, mixed=False))


@query("agg_tri_texture")
def agg_tri_texture(t):
    """The triangles of the interpolated heightmaps, with the textures of the patches mixed by place."""
    heights = heightmap.heightmaps(in_view(t, contexts(t)), fields=("height",)).filter("NOT blank").select("px", "py", "height")
    at = in_view(t, agg_texture(t)).select("px", "py", "tx", "ty", (c("r") + c("g") * 256 + c("b") * 65536).alias("colour"))
    maps = heights.join(mesh_raster.as_maps(at, "colour", "bigint"), ["px", "py"], "left")
    # a picture's patches are few, and each is asked for by those before it too: made once
    return aggregate.depth_buffer(mesh_raster.fragments(storage.kept(maps), CAMERA))


_RT = [f"({p} * 640e0 - 150e0)" for p in ("px", "py")], [f"((({p} + 1) * 640e0) + 150e0)" for p in ("px", "py")]


@query("lod_route", f"{_PATCHES};; SELECT px, py, n, NOT n >= 25 AS as_points, n >= 25 AS as_triangles FROM patches WHERE {planes_sql([*_RT[0], '0e0'], [*_RT[1], '0e0'], True)}")
def lod_route(t):
    ready = patches(t).withColumn("has_heightmap", c("n") >= 25)
    return lod.routes(ready, CAMERA).select("px", "py", "n", "as_points", "as_triangles")


_CHUNKS = _TILES + ", cs AS (SELECT tile_id, n_points, k AS chunk_idx, (tile_id * 7 + k) % 4 AS state, visible, weight FROM (SELECT tile_id, n_points, visible, weight, unnest(range(0, (n_points + 9) // 10)) AS k FROM wt) q)"
_NEXT = "CASE WHEN state = 0 AND visible THEN 1 WHEN state = 1 THEN 2 WHEN state = 2 AND NOT visible THEN 3 WHEN state = 3 THEN 0 ELSE state END"


def chunk_states(t):
    tiles = lod.weigh_tiles(t.tiles, CAMERA).select("tile_id", "n_points", "visible", "weight")
    chunks = tiles.withColumn("chunk_idx", F.explode(F.sequence(F.lit(0).cast("long"), C.chunk_count(c("n_points"), 10) - 1)))
    return chunks.withColumn("state", chunk_state(c("tile_id"), c("chunk_idx")))


@query("st_chunk_fsm", f"{_CHUNKS};; SELECT tile_id, chunk_idx, state, {_NEXT} AS next_state FROM cs")
def st_chunk_fsm(t):
    return chunk_states(t).select("tile_id", "chunk_idx", "state", lod.next_state(c("state"), c("visible")).cast("long").alias("next_state"))


@query("lim_load", f"{_CHUNKS};; SELECT tile_id, chunk_idx FROM cs WHERE state = 0 AND visible ORDER BY weight DESC, tile_id, chunk_idx LIMIT 100")
def lim_load(t):
    return lod.load_list(chunk_states(t)).select("tile_id", "chunk_idx")


@query("agg_visible_stats", f"{_CHUNKS};; SELECT count(*) AS chunks, CAST(sum(least(10, n_points - 10 * chunk_idx)) AS BIGINT) AS points FROM cs WHERE state = 2")
def agg_visible_stats(t):
    """Loaded chunks, which are those that are drawn, and their points."""
    points = F.least(F.lit(10), c("n_points") - 10 * c("chunk_idx"))
    return chunk_states(t).filter(c("state") == lod.LOADED).agg(F.count("*").alias("chunks"), F.sum(points).cast("long").alias("points"))
