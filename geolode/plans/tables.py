"""The tables of the engine: points, chunk points, tiles and patches.

Points come from a folder of LAS files (``LasTables``) or, for the queries that are checked against SQL, from the order lines: a supplier is a tile of
one square kilometre and each line a point, with raw integers as a LAS file has them.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geolode.functions import columns as C
from geolode.plans import storage
from geolode.sources import catalogue

#: Points of a chunk here; small tables would hardly have chunks of 50,000.
CHUNK = 10


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def points(self) -> DataFrame:
        order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", "l_shipdate")
        c = F.col
        raw = self.read("lineitem").select(
            c("l_suppkey").alias("tile_id"),
            (F.row_number().over(order) - 1).cast("long").alias("point_idx"),
            ((c("l_suppkey") % 10) * 100000 + (c("l_partkey") * 7919 + c("l_orderkey") * 31) % 100000).cast("int").alias("xi"),
            (F.floor(c("l_suppkey") / 10).cast("long") * 100000 + (c("l_orderkey") * 6151 + c("l_linenumber") * 977) % 100000).alias("yi"),  # beyond 32 bits from tile 214,748 on
            (F.floor("l_quantity").cast("int") * 100 + c("l_linenumber")).alias("zi"),
            ((c("l_partkey") * 97) % 65536).cast("int").alias("r16"),
            ((c("l_orderkey") * 193) % 65536).cast("int").alias("g16"),
            ((c("l_suppkey") * 389) % 256).cast("int").alias("b16"),
        )
        return raw.withColumns({a: C.dequantised(c(f"{a}i"), 0.01) for a in "xyz"} | {a: C.colour8(c(f"{a}16")) for a in "rgb"})

    @cached_property
    def chunk_points(self) -> DataFrame:
        return self.points.filter(F.col("point_idx") % CHUNK == 0)

    @cached_property
    def tiles(self) -> DataFrame:
        bounds = [f(a).alias(f"{n}_{a}") for n, f in (("min", F.min), ("max", F.max)) for a in "xyz"]
        return self.points.groupBy("tile_id").agg(F.count("*").alias("n_points"), *bounds)

    @cached_property
    def world(self) -> DataFrame:
        """One row: origin and size."""
        low = [F.min(f"min_{a}").alias(f"origin_{a}") for a in "xyz"]
        return self.tiles.agg(*low, *[(F.max(f"max_{a}") - F.min(f"min_{a}")).alias(f"size_{a}") for a in "xyz"])

    def placed(self, points: DataFrame) -> DataFrame:
        """points with local coordinates lx, ly, lz and their patch px, py. The world is one row, so it is broadcast."""
        at = points.join(F.broadcast(self.world))
        at = at.withColumns({"lx": C.local(F.col("x"), F.col("origin_x"), F.col("size_x")), "ly": C.local(F.col("y"), F.col("origin_y"), F.col("size_y")), "lz": C.clamp(F.col("z"), 0.0, F.col("size_z"))})
        return at.withColumns({"px": C.cell(F.col("lx")), "py": C.cell(F.col("ly"))})


class LasTables(Tables):
    """The same tables of a folder of LAS files: tiles and world come from a catalogue of their headers, which tasks make once, so no point is read for them.

    box (x0,y0,x1,y1) leaves out files outside by the catalogue and points outside in the others; chunk is the size of chunks of files that have none; to is
    where the catalogue is kept (else in the shared folder). A tile's id is the number in its file's name, or else a hash of its path.
    """

    def __init__(self, spark: SparkSession, folder: str, box: str | None = None, chunk: str = "0", to: str | None = None):
        super().__init__(spark, folder)
        self.box = None if box is None else tuple(float(v) for v in box.split(","))
        self.chunk, self.to = int(chunk), to

    def read(self, name: str) -> DataFrame:
        raise ValueError(f"a folder of LAS files has no table {name}")

    @cached_property
    def catalogue(self) -> DataFrame:
        found = catalogue.written(self.spark, self.sf_dir, self.to or storage.folder(self.spark, "catalogue"))
        return found if self.box is None else catalogue.inside(found, self.box)

    def _numbered(self, rows: DataFrame) -> DataFrame:
        number = F.expr("try_cast(regexp_extract(path, '([0-9]+)[.][lL][aA][sSzZ]$', 1) AS BIGINT)")
        return rows.withColumn("tile_id", F.coalesce(number, F.xxhash64("path")))

    def _rows(self, what: str) -> DataFrame:
        return self._numbered(catalogue.rows(self.catalogue, what, self.box, self.chunk)).drop("path", "a")

    @cached_property
    def points(self) -> DataFrame:
        return self._rows("points")

    @cached_property
    def chunk_points(self) -> DataFrame:
        return self._rows("chunk_points")

    @cached_property
    def tiles(self) -> DataFrame:
        return self._numbered(self.catalogue).select("tile_id", "n_points", *[f"{n}_{a}" for n in ("min", "max") for a in "xyz"])


#: The same tables in SQL.
POINTS_SQL = """
pts AS (
  SELECT tile_id, point_idx, xi, yi, zi, CAST(xi AS DOUBLE) * 1e-2 AS x, CAST(yi AS DOUBLE) * 1e-2 AS y, CAST(zi AS DOUBLE) * 1e-2 AS z, r16, g16, b16,
         CASE WHEN r16 > 255 THEN CAST(floor(r16 / 256e0) AS INT) ELSE r16 END AS r, CASE WHEN g16 > 255 THEN CAST(floor(g16 / 256e0) AS INT) ELSE g16 END AS g,
         CASE WHEN b16 > 255 THEN CAST(floor(b16 / 256e0) AS INT) ELSE b16 END AS b
  FROM (SELECT l_suppkey AS tile_id,
          CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity, l_shipdate) - 1 AS BIGINT) AS point_idx,
          CAST((l_suppkey % 10) * 100000 + (l_partkey * 7919 + l_orderkey * 31) % 100000 AS INT) AS xi,
          CAST(floor(l_suppkey / 10e0) AS INT) * 100000 + CAST((l_orderkey * 6151 + l_linenumber * 977) % 100000 AS INT) AS yi,
          CAST(floor(l_quantity) AS INT) * 100 + l_linenumber AS zi, CAST((l_partkey * 97) % 65536 AS INT) AS r16,
          CAST((l_orderkey * 193) % 65536 AS INT) AS g16, CAST((l_suppkey * 389) % 256 AS INT) AS b16
        FROM lineitem) q),
ch AS (SELECT * FROM pts WHERE point_idx % 10 = 0),
tiles AS (SELECT tile_id, count(*) AS n_points, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM pts GROUP BY tile_id),
world AS (SELECT min(min_x) AS origin_x, min(min_y) AS origin_y, min(min_z) AS origin_z, max(max_x) - min(min_x) AS size_x, max(max_y) - min(min_y) AS size_y, max(max_z) - min(min_z) AS size_z FROM tiles),
loc AS (
  SELECT *, CAST(floor(lx / 640e0) AS INT) AS px, CAST(floor(ly / 640e0) AS INT) AS py
  FROM (SELECT *, greatest(0e0, least(size_x, x - origin_x)) AS lx, greatest(0e0, least(size_y, y - origin_y)) AS ly, greatest(0e0, least(size_z, z)) AS lz FROM pts CROSS JOIN world) q),
chl AS (SELECT * FROM loc WHERE point_idx % 10 = 0)
"""
