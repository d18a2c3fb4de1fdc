"""Exact nearest neighbours over a whole table of points, however far they are.

Points lie in cells of a grid, as many to a cell as ``TARGET`` on average. A query looks at its own cell; where its k-th neighbour is not surely nearer than all that lies outside, at those of the eight
around it that may hold a nearer one, and then it goes on with cells four times as wide, until the nine of them hold all points. So most queries end in the first round, in one group, and what goes on is few.
In a task, a cell's points are a k-d tree and hand on k candidates a query, so rows grow with k and not with the points of a cell. A cell with very many points is dealt
over several trees, one with very many queries over several tasks; merging candidates is exact in any case.

Ties in distance go to the smaller id. Points with a null or NaN coordinate are no neighbours, queries with one have none. Equal places are searched once. Where there are fewer
than k points, all of them come. ids are to be unique.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.operators.grid import AROUND
from geolode.plans.storage import kept

#: Points of a cell on average; points of a tree and queries of a task at most (on average, where a cell is dealt out); points of a leaf; how much wider the next round's cells are.
TARGET, TREE, QUERIES, LEAF, WIDER = 2048, 50_000, 20_000, 128, 4.0


class Tree:
    """A k-d tree of points (n, 2) with ids, for many queries at once."""

    def __init__(self, points: np.ndarray, ids: np.ndarray) -> None:
        self.points, self.ids = points, ids
        self.top = self._node(np.arange(len(points)))

    def _node(self, at: np.ndarray) -> tuple:
        p = self.points[at]
        spread = np.ptp(p, axis=0) if len(at) else np.zeros(2)
        if len(at) <= LEAF or not spread.any():
            return (at[np.argsort(self.ids[at])],)
        axis = int(spread.argmax())
        value = float(np.median(p[:, axis]))
        low = p[:, axis] <= value
        if low.all():  # the median is the greatest value
            low = p[:, axis] < value
        return axis, value, self._node(at[low]), self._node(at[~low])

    def nearest(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and ids of the k nearest, by distance and id; infinity where there are fewer."""
        best = np.full((len(queries), k), np.inf), np.full((len(queries), k), np.iinfo(np.int64).max)
        waiting = [(self.top, np.arange(len(queries)), None)]
        while waiting:
            node, rows, away = waiting.pop()
            if away is not None:  # how far the other side is, against what has been found meanwhile
                rows = rows[away <= best[0][rows, -1]]
            if not len(rows):
                continue
            if len(node) == 1:
                self._leaf(node[0], queries, rows, best)
                continue
            axis, value, low, high = node
            gap = queries[rows, axis] - value
            left = gap <= 0
            # the near sides come off the stack first
            waiting += [(high, rows[left], gap[left] ** 2), (low, rows[~left], gap[~left] ** 2), (low, rows[left], None), (high, rows[~left], None)]
        return best

    def _leaf(self, at: np.ndarray, queries: np.ndarray, rows: np.ndarray, best: tuple[np.ndarray, np.ndarray]) -> None:
        k = best[0].shape[1]
        some = max(1, (1 << 20) // max(1, len(at)))
        for first in range(0, len(rows), some):
            r = rows[first : first + some]
            dx, dy = (self.points[at, a] - queries[r, a, None] for a in range(2))
            d2, each = dx * dx + dy * dy, np.arange(len(r))
            # the k nearest of the leaf, one after another: its ids are in order, so the first of equals is the smallest
            near = np.empty((len(r), min(k, len(at)))), np.empty((len(r), min(k, len(at))), np.int64)
            for j in range(near[0].shape[1]):
                c = d2.argmin(1)
                near[0][:, j], near[1][:, j] = d2[each, c], self.ids[at[c]]
                d2[each, c] = np.inf
            both = [np.concatenate([b[r], n], 1) for b, n in zip(best, near, strict=True)]
            order = np.lexsort(both[::-1], axis=1)[:, :k]
            best[0][r], best[1][r] = (np.take_along_axis(b, order, 1) for b in both)


def _sound(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.filter(F.col(name).isNotNull() & ~F.isnan(F.col(name)))
    return df


def _dealt(df: DataFrame) -> DataFrame:
    """df, for a join that deals both sides by key: tables that grow with the points may be small as files, and would be broadcast through the driver."""
    return df.hint("merge")


def _cell(value: str, size: float) -> Column:
    return F.floor(F.col(value) / size).cast("long")


def _candidates(k: int):
    def run(key: tuple, queries: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        d2, ids = Tree(points[["x", "y"]].to_numpy(float), points["id"].to_numpy(np.int64)).nearest(queries[["qx", "qy"]].to_numpy(float), k)
        row, at = np.nonzero(np.isfinite(d2))
        return pd.DataFrame({"qx": queries["qx"].to_numpy()[row], "qy": queries["qy"].to_numpy()[row], "d2": d2[row, at], "id": ids[row, at]})

    return run


def _round(points: DataFrame, waiting: DataFrame, k: int, size: float, around: list[tuple[int, int]]) -> DataFrame:
    """waiting (qx, qy, best) with best of these cells around each query, too."""
    at = points.withColumns({"gx": _cell("x", size), "gy": _cell("y", size)})
    cells = at.groupBy("gx", "gy").agg(F.ceil(F.count("*") / TREE).cast("int").alias("trees"))
    offsets = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in around])).alias("o")
    asked = waiting.select("qx", "qy", F.get("best", F.lit(k - 1))["d2"].alias("far"), offsets)
    asked = asked.select("qx", "qy", "far", (_cell("qx", size) + F.col("o.dx")).alias("gx"), (_cell("qy", size) + F.col("o.dy")).alias("gy"))
    # how far the cell is at least; it needs no look where k points are nearer
    apart = [F.greatest(F.col(g) * size - F.col(q), F.col(q) - (F.col(g) + 1) * size, F.lit(0.0)) for g, q in (("gx", "qx"), ("gy", "qy"))]
    asked = asked.filter(F.col("far").isNull() | ((apart[0] * apart[0] + apart[1] * apart[1]) * (1 - 1e-9) <= F.col("far"))).join(_dealt(cells), ["gx", "gy"])
    asked = kept(asked.select("qx", "qy", "gx", "gy", "trees"))
    shares = asked.groupBy("gx", "gy").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("shares"), F.first("trees").alias("trees"))
    sent = asked.join(_dealt(shares.select("gx", "gy", "shares")), ["gx", "gy"]).withColumn("share", F.pmod(F.xxhash64("qx", "qy"), F.col("shares")).cast("int"))
    sent = sent.select("qx", "qy", "gx", "gy", "share", F.explode(F.sequence(F.lit(0), F.col("trees") - 1)).alias("tree"))
    held = at.join(_dealt(shares), ["gx", "gy"]).withColumn("tree", F.pmod(F.xxhash64("id"), F.col("trees")).cast("int"))
    held = held.select("x", "y", "id", "gx", "gy", "tree", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    key = ["gx", "gy", "tree", "share"]
    found = sent.groupBy(*key).cogroup(held.groupBy(*key)).applyInPandas(_candidates(k), "qx double, qy double, d2 double, id bigint")
    best = found.groupBy("qx", "qy").agg(F.slice(F.sort_array(F.collect_list(F.struct("d2", "id"))), 1, k).alias("best"))
    # a cell that was passed over holds nothing nearer, so what was known before counts too
    both = waiting.withColumnRenamed("best", "before").join(_dealt(best), ["qx", "qy"], "left")
    none = F.array().cast(waiting.schema["best"].dataType)
    union = F.array_sort(F.array_union(F.coalesce("before", none), F.coalesce("best", none)))
    return both.select("qx", "qy", F.slice(union, 1, k).alias("best"))


def nearest(points: DataFrame, queries: DataFrame, k: int = 1, size: float | None = None) -> DataFrame:
    """queries (qx, qy and others), repeated for their k nearest points (x, y, id): d2 (squared distance), id and rank from 1 on."""
    p, places = _sound(points.select(F.col("x").cast("double"), F.col("y").cast("double"), F.col("id").cast("long")), "x", "y"), _sound(queries.select("qx", "qy"), "qx", "qy").distinct()
    a = p.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in "xy" for f in (F.min, F.max)]).first()
    out = queries.schema.add("d2", "double").add("id", "long").add("rank", "integer")
    if not a["n"]:
        return queries.sparkSession.createDataFrame([], out)
    p = kept(p)
    wide = max(a["max_x"] - a["min_x"], a["max_y"] - a["min_y"])
    size = size or max((max(a["max_x"] - a["min_x"], 1e-9) * max(a["max_y"] - a["min_y"], 1e-9) * TARGET / a["n"]) ** 0.5, wide * 1e-6, 1e-9)
    waiting = places.withColumn("best", F.array().cast("array<struct<d2:double,id:bigint>>"))
    ends: DataFrame | None = None
    own, beside = [(0, 0)], [o for o in AROUND if o != (0, 0)]
    cells, reach = own, 0
    while True:
        side = [(F.col(q) - _cell(q, size) * size) for q in ("qx", "qy")]
        border = F.least(*[F.least(s, F.lit(size) - s) for s in side]) + F.lit(reach * size)  # to the edge of the cells that were looked at
        kth = F.get("best", F.lit(k - 1))["d2"]
        # or they hold the box of all points
        held = [((_cell(f"q{c}", size) - reach) * size <= a[f"min_{c}"]) & ((_cell(f"q{c}", size) + (1 + reach)) * size > a[f"max_{c}"]) for c in "xy"]
        sure = F.coalesce(kth < border * border * (1 - 1e-9), F.lit(False)) | (held[0] & held[1])
        found = kept(_round(p, waiting, k, size, cells).withColumn("sure", sure))
        some = found.filter("sure").drop("sure")
        ends = some if ends is None else ends.unionByName(some)
        waiting = found.filter("NOT sure").drop("sure")
        if waiting.isEmpty():
            break
        if reach:
            size, cells = size * WIDER, AROUND
        else:  # the cells beside those of the first round
            cells, reach = beside, 1
    best = ends.select("qx", "qy", F.posexplode("best").alias("rank", "b")).select("qx", "qy", "b.d2", "b.id", (F.col("rank") + 1).alias("rank"))
    return queries.join(_dealt(best), ["qx", "qy"]).select(*queries.columns, "d2", "id", "rank")
