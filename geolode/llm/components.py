"""Connected components of a table of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolode.llm.common import saved


#: Links that a task handles at least, and tasks at least.
LINKS, LEAST_TASKS = 5000, 8


def components(links: DataFrame) -> DataFrame:
    """node and component (its smallest node) for every node of links (u, v).

    Each round hangs the larger neighbours of a node, then its smaller ones, on the smallest; rounds grow with the logarithm
    of the nodes. Minima are pre-aggregated, and a node with very many links is only a skewed key of an inner join,
    which adaptive execution splits. Every round is saved to the checkpoint folder. Few links are handled by few tasks, as each task
    of each round leaves files behind.
    """
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges, before = saved(edges), None
    while True:
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        before = state
        tasks = max(LEAST_TASKS, -(-state[0] // LINKS))
        edges = edges.coalesce(tasks)
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").coalesce(2 * tasks).distinct().coalesce(2 * tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m"))
        edges = saved(small.coalesce(2 * tasks).distinct().coalesce(2 * tasks))
