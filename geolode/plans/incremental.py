"""Streams: folders of LAS files play the points, their headers and chunk tables; events play what has a time."""

from dataclasses import replace

from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.plans.aggregations import _TEXELS
from geolode.plans.joins import _PATCHES, chunk_state
from geolode.plans.registry import number, query
from geolode.plans.scans import files as tile_files
from geolode.plans.storage import folder, kept
from geolode.plans.views import CAMERA
from geolode.streaming import frames, ingest, textures

c = F.col


def stream(t):
    # a pattern, as the stream source takes a plain path for a folder
    return ingest.read_stream(t.spark, f"{t.sf_dir}/[e]vents.parquet", t.read("events").schema)


def las_folder(t, **options):
    """The tiles as LAS files in a folder, and the number of files for a batch so that there are some four batches."""
    from geolode.sources import las

    path = folder(t.spark, "las")
    las.register(t.spark)
    tile_files(t, **options).write.format("files").mode("append").option("path", path).save()
    return path, -(-t.tiles.count() // 4)


def las_stream(t, path, what, some):
    rows = ingest.read_las_stream(t.spark, path, what, folder(t.spark, "log"), some, chunk=10)
    return rows.withColumn("tile_id", F.regexp_extract("path", r"tile_(\d+)[.]la[sz]$", 1).cast("long"))


@query("st_source", "SELECT tile_id, point_idx, xi, yi, zi FROM ch")
def st_source(t):
    """The chunk points of a folder, some files a batch."""
    rows = las_stream(t, *(lambda f: (f[0], "chunk_points", f[1]))(las_folder(t)))
    return ingest.finish(rows.select("tile_id", "point_idx", "xi", "yi", "zi"), folder(t.spark, "source"), in_batches=True).drop("batch")


@query("st_headers_once", "SELECT tile_id, point_idx, n_points, x BETWEEN min_x AND max_x AS inside FROM ch JOIN tiles USING (tile_id)")
def st_headers_once(t):
    """Headers come as a stream of their own; chunk points are joined with the table that they left."""
    path, some = las_folder(t)
    headers = ingest.finish(las_stream(t, path, "headers", some), folder(t.spark, "headers"), in_batches=True).select("tile_id", "n_points", "min_x", "max_x")
    rows = ingest.with_files(las_stream(t, path, "chunk_points", some), headers, "tile_id")
    near = (c("x") >= c("min_x") - 1e-6) & (c("x") <= c("max_x") + 1e-6)
    return ingest.finish(rows.select("tile_id", "point_idx", "n_points", near.alias("inside")), folder(t.spark, "points"), in_batches=True).drop("batch")


@query("st_tables", "SELECT tile_id, count(*) AS chunks, CAST(sum(26 + 7 * (k % 5)) AS BIGINT) AS bytes FROM (SELECT tile_id, unnest(range(0, (n_points + 9) // 10)) AS k FROM tiles) q GROUP BY tile_id")
def st_tables(t):
    """Chunk tables of compressed files, as they come, by file."""
    path, some = las_folder(t, compressed=True)
    sizes = las_stream(t, path, "chunks", some).groupBy("tile_id").agg(F.count("*").alias("chunks"), F.sum("byte_size").alias("bytes"))
    return ingest.finish(sizes, folder(t.spark, "tables"), "complete", in_batches=True).drop("batch")


def placed_stream(t):
    """Chunk points with their patches, from a table of several files, a file a batch."""
    table = kept(t.placed(t.chunk_points).select("px", "py", "tile_id", "point_idx", "zi").repartition(4, "tile_id"))
    return table, ingest.read_stream(t.spark, table.inputFiles()[0].rsplit("/", 1)[0], table.schema)


@query("st_patch_state", "SELECT px, py, count(*) AS n, CAST(sum(zi) AS BIGINT) AS total, min(zi) AS low, max(zi) AS high FROM chl GROUP BY px, py")
def st_patch_state(t):
    return ingest.finish(ingest.accumulate(placed_stream(t)[1], ["px", "py"], "zi"), folder(t.spark, "patches"), "complete").drop("batch")


@query("st_complete", f"{_PATCHES};; SELECT a.px, a.py, CAST(sum(b.n) AS BIGINT) AS n FROM patches a JOIN patches b ON abs(a.px - b.px) <= 1 AND abs(a.py - b.py) <= 1 GROUP BY a.px, a.py")
def st_complete(t):
    """Patches whose own points and those of the eight around them have all come."""
    table, points = placed_stream(t)
    expected = table.groupBy("px", "py").agg(F.count("*").alias("expected"))
    return ingest.finish(ingest.completed(points, expected), folder(t.spark, "complete")).drop("batch")


@query("st_texture", f"SELECT px, py, tx, ty, {', '.join(f'CAST(floor(sum({a}) / count(*)) AS INT) AS {a}' for a in 'rgb')}, 255 AS a, count(*) AS n FROM (SELECT r, g, b, {_TEXELS} FROM chl) q GROUP BY px, py, tx, ty HAVING count(*) > 0")
def st_texture(t):
    """Textures that chunk points are added to, some a batch."""
    at = t.placed(t.chunk_points).drop("px", "py").withColumns({f"g{a}": C.texel(c(f"l{a}")) for a in "xy"})
    cells = [e for a in "xy" for e in (F.floor(c(f"g{a}") / C.TEXELS).cast("int").alias(f"p{a}"), F.pmod(c(f"g{a}"), F.lit(C.TEXELS)).alias(f"t{a}"))]
    table = kept(at.select(*cells, *"rgb", "tile_id").repartition(4, "tile_id"))
    path = folder(t.spark, "textures")
    textures.load(ingest.read_stream(t.spark, table.inputFiles()[0].rsplit("/", 1)[0], table.schema), path)
    return textures.textures(t.spark, path, 0)


# a flight over the world, a frame for each nation
_VIEW = {"yaw": (0.25, 0.1), "pitch": (-0.03, -0.4), "radius": (150.0, 900.0), "target_x": (350.0, 400.0), "target_y": (20.0, 300.0)}
_FLIGHT = [(k, replace(CAMERA, yaw=v["yaw"], pitch=v["pitch"], radius=v["radius"], target=(v["target_x"], v["target_y"], 0.0)).planes.ravel().tolist()) for k in range(25) for v in [{n: a * k + b for n, (a, b) in _VIEW.items()}]]
_SEEN = " AND ".join("(" + " + ".join(f"p[{4 * k + d + 1}] * CASE WHEN p[{4 * k + d + 1}] > 0 THEN max_{a} ELSE min_{a} END" for d, a in enumerate("xyz")) + f" + p[{4 * k + 4}] >= 0)" for k in range(6))


def flight(t):
    """The frames as a stream of cameras, some a batch."""
    k = c("n_nationkey").cast("double")
    views = t.read("nation").select(c("n_nationkey").cast("long").alias("frame"), *[(k * a + b).alias(n) for n, (a, b) in _VIEW.items()], F.lit(0.0).alias("target_z"))
    path = folder(t.spark, "frames")
    for low in range(0, 25, 7):  # a file for each run of frames, one after another
        views.filter(c("frame").between(low, low + 6)).coalesce(1).write.mode("append").parquet(path)
    return ingest.read_stream(t.spark, path, views.schema)


@query("st_actions", f"""fl(frame, p) AS (VALUES {', '.join(f"({k}, [{', '.join(number(x) for x in p)}])" for k, p in _FLIGHT)}), vis AS (SELECT frame, tile_id, {_SEEN} AS visible FROM fl CROSS JOIN tiles);;
  SELECT tile_id, CAST(frame AS BIGINT) AS frame, chunk_idx, CASE state WHEN 1 THEN 'READ' ELSE 'UNLOAD' END AS action FROM (
    WITH RECURSIVE fs AS (
      SELECT tile_id, k AS chunk_idx, -1 AS frame, CAST(-1 AS BIGINT) AS before, CAST((tile_id * 7 + k) % 4 AS BIGINT) AS state FROM (SELECT tile_id, unnest(range(0, (n_points + 9) // 10)) AS k FROM tiles) q
      UNION ALL SELECT fs.tile_id, chunk_idx, vis.frame, state,
        CASE WHEN state = 0 AND visible THEN 1 WHEN state = 1 THEN 2 WHEN state = 2 AND NOT visible THEN 3 WHEN state = 3 THEN 0 ELSE state END
      FROM fs JOIN vis ON fs.tile_id = vis.tile_id AND vis.frame = fs.frame + 1)
    SELECT * FROM fs WHERE frame >= 0 AND before <> state AND state IN (1, 3)) q""")
def st_actions(t):
    """What every frame of a flight has to read and to unload; chunks keep their states between batches of frames."""
    first = F.transform(F.sequence(F.lit(0), F.col("n_chunks") - 1), lambda k: chunk_state(c("tile_id"), k).cast("int"))
    tiles = kept(t.tiles.withColumn("n_chunks", C.chunk_count(c("n_points"), 10)))  # every batch looks at them
    store = t.spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    frames.with_store(t.spark)
    try:
        return ingest.finish(frames.actions(flight(t), tiles, CAMERA, first), folder(t.spark, "actions")).drop("batch")
    finally:
        t.spark.conf.set("spark.sql.streaming.stateStore.providerClass", store) if store else t.spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


@query("st_early_buffer", "SELECT user_id, event_id AS id FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'click')")
def st_early_buffer(t):
    rows = stream(t).select("user_id", c("event_id").alias("id"), c("event_type").alias("kind"))
    return ingest.finish(ingest.held_back(rows, "user_id", "click", "user_id bigint, id bigint"), folder(t.spark, "early")).drop("batch")


@query("st_priority", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 100")
def st_priority(t):
    return ingest.running_top(stream(t).select("event_id", "value"), folder(t.spark, "priority"), "value", ["event_id"])


@query("st_windows", "SELECT event_type, strftime(date_trunc('day', CAST(ts AS TIMESTAMP)), '%Y-%m-%d %H:%M:%S') AS day, count(*) AS n FROM events GROUP BY 1, 2")
def st_windows(t):
    events = stream(t).withColumn("time", c("ts").cast("timestamp"))
    counted = ingest.windowed(events, "time", "10 minutes", "1 day", "event_type")
    return ingest.finish(counted, folder(t.spark, "windows"), "complete").select("event_type", c("window.start").cast("string").alias("day"), "n")
