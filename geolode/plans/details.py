"""Parts of the larger operators as queries of their own: coding, ranges of bytes, shading, model inputs, work limits."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.operators import heightmap
from geolode.plans import storage
from geolode.plans.geometry import _NEAR, _NEAREST, mean_filter
from geolode.plans.joins import _CONTEXT, _SIZES, chunk_sizes, contexts
from geolode.plans.registry import number, query
from geolode.plans.scans import files
from geolode.sources import las, sinks

c = F.col


@query("win_delta_pred", _SIZES + ";; SELECT tile_id, chunk_idx, CAST(byte_size - coalesce(lag(byte_size) OVER (PARTITION BY tile_id ORDER BY chunk_idx), 0) AS BIGINT) AS value FROM sizes")
def win_delta_pred(t):
    before = F.lag("byte_size").over(Window.partitionBy("tile_id").orderBy("chunk_idx"))
    return chunk_sizes(t).select("tile_id", "chunk_idx", (c("byte_size") - F.coalesce(before, F.lit(0))).cast("long").alias("value"))


@query("src_native_read", "SELECT tile_id, point_idx, xi, yi, zi FROM ch")
def src_native_read(t):
    """Ranges of bytes: the first twelve of each chunk's first record, from written files."""
    path = storage.folder(t.spark, "files")
    las.register(t.spark)
    files(t).write.format("files").mode("append").option("path", path).save()
    first = las.list_files(t.spark, path).withColumn("k", F.explode(F.sequence(F.lit(227).cast("long"), c("length") - 26, F.lit(260).cast("long"))))
    found = las.byte_ranges(first.select("path", c("k").alias("start"), F.lit(12).cast("long").alias("n")))
    number = lambda at: sum(F.conv(F.hex(F.substring("bytes", at + b, 1)), 16, 10).cast("long") * (1 << 8 * b) for b in range(4))
    whole = {a: number(1 + 4 * k).alias(a) for k, a in enumerate(("xi", "yi", "zi"))}
    signed = lambda a: (c(a) - F.when(c(a) >= 1 << 31, 1 << 32).otherwise(0)).cast("int").alias(a)
    tile = F.regexp_extract("path", r"tile_(\d+)[.]las$", 1).cast("long").alias("tile_id")
    return found.select(tile, ((c("start") - 227) / 26).cast("long").alias("point_idx"), *whole.values()).select("tile_id", "point_idx", *[signed(a) for a in whole])


@query("prj_shade", "SELECT tile_id, point_idx, r, g, b FROM pts WHERE zi % 256 >= 150")
def prj_shade(t):
    return t.points.filter(C.drawn(c("zi") % 256)).select("tile_id", "point_idx", *[C.shaded(c(a)).alias(a) for a in "rgb"])


@query("st_tween", "SELECT event_id, greatest(0e0, least(1e0, (value - 10e0) / 50e0)) AS u FROM events")
def st_tween(t):
    return t.read("events").select("event_id", C.animation(c("value"), 10.0, 50.0).alias("u"))


@query("ml_dict", f"{_CONTEXT}, {_NEAR}, {_NEAREST}, base AS (SELECT px, py, avg(lz) AS base FROM ctx GROUP BY px, py);; SELECT px, py, round((avg(lz) - max(base)) / {number(C.RADIUS)} * 10e0, 6) AS height, round(avg(r) / 256e0, 6) AS red, 64 AS heights, 192 AS colours FROM nr JOIN base USING (px, py) GROUP BY px, py")
def ml_dict(t):
    """Mean normalised height and redness, and sizes, of the nearest maps that a model gets (8 x 8 here)."""
    maps = heightmap.model_inputs(contexts(t), 8)
    mean = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / F.size(a), 6)
    return maps.select("px", "py", mean(c("patch_hm_nearest")).alias("height"), mean(F.slice("patch_rgb_nearest", 1, 64)).alias("red"), F.size("patch_hm_linear").alias("heights"), F.size("patch_rgb_nearest").alias("colours"))


def stacked(maps):
    return np.stack([mean_filter({k: v[i] for k, v in maps.items()}) for i in range(len(maps["patch_hm_linear"]))])


def inferred(t, batch):
    found = heightmap.infer(contexts(t), stacked, batch)
    return found.select("px", "py", F.round(F.array_max("height"), 6).alias("top"))


@query("ml_batch")
def ml_batch(t):
    return inferred(t, 5)


@query("ml_api")
def ml_api(t):
    return inferred(t, 1)


@query("snk_off")
def snk_off(t):
    """The lines of each patch's OFF."""
    return sinks.off_files(contexts(t)).select("px", "py", (F.length("content") - F.length(F.translate("content", "\n", ""))).alias("lines"))
