"""Joins and samples over a regular grid: every spatial predicate becomes an equi-join on cell keys plus a filter.

A point is in one cell and a box in few, so a hot cell is the only skew; joins are inner joins on the cell, which adaptive
execution splits. Nothing is broadcast unless its size has a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geolode.functions import columns as C

#: The eight cells around one, and it.
AROUND = [(dx, dy) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]


def covered_cells(boxes: DataFrame, low_x: Column, low_y: Column, high_x: Column, high_y: Column, size: float = C.PATCH, beyond: bool = False, closed: bool = False) -> DataFrame:
    """boxes, repeated for each cell px, py that they cover; with beyond also the cells after them, as the loader makes them, and closed with the cells whose far edge they touch."""
    end = (lambda v: F.ceil(v / size).cast("int")) if beyond else (lambda v: C.cell(v, size))
    begin = (lambda v: (F.ceil(v / size) - 1).cast("int")) if closed else (lambda v: C.cell(v, size))
    xs, ys = F.sequence(begin(low_x), end(high_x)), F.sequence(begin(low_y), end(high_y))
    return boxes.withColumn("px", F.explode(xs)).withColumn("py", F.explode(ys))


def with_neighbours(points: DataFrame, px: str = "px", py: str = "py", to: tuple[str, str] = ("to_px", "to_py")) -> DataFrame:
    """points, repeated for the nine cells around theirs."""
    offsets = F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in AROUND])
    df = points.withColumn("__o", F.explode(offsets))
    return df.withColumns({to[0]: F.col(px) + F.col("__o.dx"), to[1]: F.col(py) + F.col("__o.dy")}).drop("__o")


def context(points: DataFrame, patches: DataFrame, margin: float = C.MARGIN + 1, size: float = C.PATCH) -> DataFrame:
    """points (lx, ly, px, py and others) of each patch (px, py) and of the margin around it, borders included.

    Points near no border stay in their own patch: a point is sent only to the cells whose margin reaches it.
    """
    low = lambda v: C.cell(v - margin, size)
    high = lambda v: C.cell(v + margin, size)
    sent = points.withColumns({"own_px": F.col("px"), "own_py": F.col("py")}).drop("px", "py")
    # a point exactly on the outer border of a margin belongs to it, though its cell does not reach that far
    first_x = F.when((F.col("lx") - margin) % size == 0, low(F.col("lx")) - 1).otherwise(low(F.col("lx")))
    first_y = F.when((F.col("ly") - margin) % size == 0, low(F.col("ly")) - 1).otherwise(low(F.col("ly")))
    sent = sent.withColumn("px", F.explode(F.sequence(first_x, high(F.col("lx"))))).withColumn("py", F.explode(F.sequence(first_y, high(F.col("ly")))))
    near = [(F.col(v) >= F.col(p) * size - margin) & (F.col(v) <= (F.col(p) + 1) * size + margin) for v, p in (("lx", "px"), ("ly", "py"))]
    return sent.filter(near[0] & near[1]).join(patches.select("px", "py"), ["px", "py"])


def nearest(points: DataFrame, queries: DataFrame, key: list[str], k: int = 1) -> DataFrame:
    """For every row of queries (qx, qy) the k nearest points (x, y, id) of the same key, by squared distance and then id."""
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    pairs = queries.join(points, key).withColumn("d2", dx * dx + dy * dy)
    if k == 1:
        keys = [c for c in queries.columns]
        return pairs.groupBy(*keys).agg(F.min(F.struct("d2", "id")).alias("n")).select(*keys, "n.d2", "n.id", F.lit(1).alias("rank"))
    order = Window.partitionBy(*queries.columns).orderBy("d2", "id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select(*queries.columns, "d2", "id", "rank")


def within(points: DataFrame, queries: DataFrame, radius: float) -> DataFrame:
    """Pairs of queries (qid, qx, qy) and points (id, x, y) at a squared distance of at most radius squared."""
    cells = queries.withColumns({"gx": C.cell(F.col("qx"), radius), "gy": C.cell(F.col("qy"), radius)})
    around = with_neighbours(cells, "gx", "gy", ("cx", "cy")).drop("gx", "gy")
    placed = points.withColumns({"cx": C.cell(F.col("x"), radius), "cy": C.cell(F.col("y"), radius)})
    dx, dy = F.col("x") - F.col("qx"), F.col("y") - F.col("qy")
    return around.join(placed, ["cx", "cy"]).withColumn("d2", dx * dx + dy * dy).filter(F.col("d2") <= radius * radius).drop("cx", "cy")


def voxel_sample(points: DataFrame, size: float) -> DataFrame:
    """Of each voxel the point (x, y, z, tile_id, point_idx) nearest to the voxel's barycentre; ties by tile and index."""
    keyed = points.withColumns({f"v{a}": C.cell(F.col(a), size) for a in "xyz"})
    keys = ["vx", "vy", "vz"]
    # means of raw integers are the same in any order
    centre = keyed.groupBy(*keys).agg(*[(F.sum(f"{a}i") / F.count("*") * 1e-2).alias(f"c{a}") for a in "xyz"], F.count("*").alias("n"))
    away = sum(((F.col(a) - F.col(f"c{a}")) * (F.col(a) - F.col(f"c{a}")) for a in "xyz"), F.lit(0.0))
    best = keyed.join(centre, keys).groupBy(*keys, "n").agg(F.min(F.struct(F.round(away, 6).alias("d2"), "tile_id", "point_idx")).alias("b"))
    return best.select(*keys, "n", "b.tile_id", "b.point_idx")


def every(df: DataFrame, index: str, step: int) -> DataFrame:
    """Every step-th row by its index; the filter is pushed to the scan where the index is stored."""
    return df.filter(F.pmod(F.col(index), F.lit(step)) == 0)


def first_of_each(df: DataFrame, keys: list[str], order: tuple[str, ...], most: int) -> DataFrame:
    """The first rows (at most so many) of each key by order. Up to a limit of Spark's on the rank, tasks cut each key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= most).drop("__rank")


def uniform(key: Column, seed: int) -> Column:
    """A number from 0 to 1 (exclusive) for a key: 32 bits of a hash."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long") / float(1 << 32)
