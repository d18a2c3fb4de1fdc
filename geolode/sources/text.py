"""Text formats: PLY, OBJ, patch samples, camera tables and triangle files, read as lines and parsed by expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NUMBER = r"[-+0-9.eE]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """path, n (line number from 0 in its file) and line. Files of these formats are small; each is read by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.select("path", F.posexplode(F.split("value", r"\r?\n")).alias("n", "line"))


def ply(text: DataFrame) -> DataFrame:
    """path, n, x, y, z, r, g, b, a of ascii PLY lines: those with seven numbers after the header."""
    body = text.join(text.filter(F.trim("line") == "end_header").select("path", F.col("n").alias("end")), "path").filter(F.col("n") > F.col("end"))
    parts = body.withColumn("p", F.split(F.trim("line"), " +")).filter(F.size("p") >= 7)
    return parts.select("path", (F.col("n") - F.col("end") - 1).alias("n"), *[F.col("p")[k].cast("double").alias(a) for k, a in enumerate("xyz")], *[F.col("p")[k + 3].cast("int").alias(a) for k, a in enumerate("rgba")])


def obj(text: DataFrame) -> DataFrame:
    """A row per corner of each triangle of Wavefront OBJ lines: path, triangle, corner, x, y, z, u, v. Polygons become fans."""
    words = text.withColumn("p", F.split(F.trim("line"), r"\s+"))

    def listed(kind: str, names: list[str]) -> DataFrame:
        order = Window.partitionBy("path").orderBy("n")
        return words.filter(F.col("p")[0] == kind).select("path", F.row_number().over(order).alias(f"{kind}_id"), *[F.get("p", F.lit(k + 1)).cast("double").alias(a) for k, a in enumerate(names)])

    faces = words.filter(F.col("p")[0] == "f").withColumn("corners", F.filter(F.slice("p", 2, 1000), lambda x: x != ""))
    fans = faces.select("path", "n", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("corners") - 2), lambda k: F.array(F.col("corners")[0], F.col("corners")[k], F.col("corners")[k + 1]))).alias("k", "t"))
    numbered = fans.withColumn("triangle", F.row_number().over(Window.partitionBy("path").orderBy("n", "k")) - 1)
    corners = numbered.select("path", "triangle", F.posexplode("t").alias("corner", "ref")).withColumn("r", F.split("ref", "/"))
    corners = corners.select("path", "triangle", "corner", F.col("r")[0].cast("int").alias("v_id"), F.expr("try_cast(get(r, 1) AS INT)").alias("vt_id"))
    return corners.join(listed("v", ["x", "y", "z"]), ["path", "v_id"]).join(listed("vt", ["u", "v"]), ["path", "vt_id"], "left").select("path", "triangle", "corner", "x", "y", "z", "u", "v")


def cameras(text: DataFrame) -> DataFrame:
    """Keyframes of a table of white-space separated numbers, its first line skipped: time, yaw, pitch, radius, target_x, target_y, target_z."""
    names = ("time", "yaw", "pitch", "radius", "target_x", "target_y", "target_z")
    parts = text.filter("n > 0").withColumn("p", F.split(F.trim("line"), r"\s+")).filter(F.size("p") >= 7)
    return parts.select("path", "n", *[F.col("p")[k].cast("double").alias(a) for k, a in enumerate(names)])


def poly_points(text: DataFrame) -> DataFrame:
    """Points of .node or .poly lines: id, x, y, after a head of their number; # begins a comment."""
    rows = text.withColumn("p", F.split(F.trim(F.regexp_replace("line", "#.*", "")), r"\s+")).filter(F.col("p")[0] != "")
    order = Window.partitionBy("path").orderBy("n")
    rows = rows.withColumn("k", F.row_number().over(order)).withColumn("points", F.first(F.col("p")[0].cast("int")).over(order))
    return rows.filter("k > 1 AND k <= points + 1").select("path", *[F.col("p")[k].cast(t).alias(a) for k, (a, t) in enumerate((("id", "int"), ("x", "double"), ("y", "double")))])


def samples(spark: SparkSession, path: str) -> DataFrame:
    """A patch's samples.csv."""
    return spark.read.csv(path, schema="x double, y double, z double, r double, g double, b double", header=True)
