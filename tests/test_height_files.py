"""Files of height rasters: what they hold, odd cells, and how they are dealt out and read back."""

import math
import re

import numpy as np
import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from geolode.plans import registry
from geolode.sources import sinks

HEIGHTS = "ix int, iy int, height double"


def raster(spark, cells):
    return spark.createDataFrame([(x, y, h) for (x, y), h in cells.items()], HEIGHTS).repartition(3)


def cells_of(n, seed=1):
    rng = np.random.default_rng(seed)
    return {(int(x), int(y)): float(h) for (x, y), h in zip(rng.integers(-150, 150, (n, 2)), rng.uniform(-5, 60, n), strict=True)}


def pixels(df):
    return {(r.ix, r.iy): (r.height, r.grey) for r in df.collect()}


def test_blocks_come_back_whole(spark):
    """Blocks on both sides of 0, over batches that end inside of them."""
    cells = cells_of(3000)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        files = sinks.height_files(raster(spark, cells))
        content = {r.path: bytes(r.content) for r in files.collect()}
        got = pixels(sinks.read_height_files(files))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    blocks = {(x // 64, y // 64) for x, y in cells}
    assert content.keys() == {f"{bx}_{by}.{kind}" for bx, by in blocks for kind in ("ppm", "heightmap")} and files.count() == 2 * len(blocks)
    for bx, by in blocks:
        h = np.zeros((64, 64), np.float32)
        for (x, y), v in cells.items():
            if (x // 64, y // 64) == (bx, by):
                h[y % 64, x % 64] = v
        grey = np.clip(h * 10, 0, 65535).astype(">u2")
        assert content[f"{bx}_{by}.heightmap"] == h.tobytes()
        assert content[f"{bx}_{by}.ppm"] == b"P6 64 64 65535\n" + np.repeat(grey[..., None], 3, 2).tobytes()
        for y, x in np.ndindex(64, 64):
            assert got.pop((x + bx * 64, y + by * 64)) == (h[y, x], grey[y, x])
    assert not got


def test_only_pixels_above_leave_the_reader(spark):
    """As a filter after it: heights at or below it, missing ones and ones that aren't numbers are left out; a block without any gives no row."""
    cells = cells_of(500) | {(1000, 1000): 0.0, (1001, 1000): -3.0, (2000, 0): None, (2001, 0): math.nan, (2002, 0): math.inf, (2003, 0): 1e-40, (2004, 0): 7000.0}
    files = sinks.height_files(raster(spark, cells))
    whole, above = sinks.read_height_files(files), sinks.read_height_files(files, above=0.0)
    assert pixels(above) == pixels(whole.filter("height > 0"))
    assert above.count() == sum(h is not None and h > 0 for h in cells.values())
    assert whole.count() == 4096 * len({(x // 64, y // 64) for x, y in cells})
    assert pixels(above)[2002, 0] == (math.inf, 65535) and pixels(above)[2004, 0] == (7000.0, 65535)
    assert {(r.ix, r.iy) for r in whole.filter("height IS NULL").collect()} == {(2000, 0), (2001, 0)}
    assert not pixels(above.filter("ix BETWEEN 960 AND 1023"))


def test_files_in_any_order_and_with_more_columns(spark):
    files = sinks.height_files(raster(spark, cells_of(300)))
    mixed = files.select(F.lit(1).alias("block"), "content", F.octet_length("content").alias("length"), "path").orderBy(F.xxhash64("path"))
    assert pixels(sinks.read_height_files(mixed)) == pixels(sinks.read_height_files(files))


def test_other_sizes_and_no_rows(spark):
    cells = cells_of(200)
    files = sinks.height_files(raster(spark, cells), 16)
    assert pixels(sinks.read_height_files(files, 16, above=0.0)) == {k: (np.float32(h), int(np.float32(h) * np.float32(10))) for k, h in cells.items() if h > 0}
    assert sinks.read_height_files(sinks.height_files(spark.createDataFrame([], HEIGHTS))).count() == 0


def test_cells_without_a_place_raise(spark):
    with pytest.raises(PythonException):
        sinks.height_files(raster(spark, {(1, 1): 2.0, (None, 1): 2.0})).count()


def test_plan_of_written_and_read_heights(spark, sf_dir):
    """Cells are sorted by one number and handed over in batches, not a data frame a block, and no pixel leaves the reader to be dropped."""
    plan = registry.queries()["snk_heightmap"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
    assert "Filter" not in plan.split("FlatMapGroupsInArrow")[0]
    sort = next(x for x in plan.split("MapInArrow", 1)[1].splitlines() if "- Sort [" in x)
    assert len(re.findall("ASC|DESC", sort)) == 1
    dealt = plan.split("MapInArrow", 1)[1]
    assert "REPARTITION_BY_NUM" in dealt.splitlines()[2]
    assert len(re.search(r"MapInArrow run\(([^)]*)\)", plan)[1].split(",")) == 3
