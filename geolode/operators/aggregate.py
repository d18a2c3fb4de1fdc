"""Aggregates: depth buffers, textures, medians, progress. All of them combine partially before their shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolode.functions import columns as C


def mean_colour(df: DataFrame, *keys: str) -> DataFrame:
    """Whole-number mean of r, g and b and the number of rows by keys."""
    return df.groupBy(*keys).agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(c) for c in "rgb"], F.count("*").alias("n"))


#: Pixels of a picture whose least depths may be broadcast (some 30 bytes each).
BROADCAST_PIXELS = 1 << 20


def depth_buffer(fragments: DataFrame, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """Of each pixel the nearest fragment's depth (in thousandths, below 2 million) and colour (32 bits); equal depths take the smaller colour.

    Both are packed into one long, so the minimum is a hash aggregate that combines before the shuffle. A depth beyond raises an error.
    """
    far = F.col("depth") >= 2_147_483
    both = F.when(~far, F.round(F.col("depth") * 1000).cast("long") * C.U32 + F.col("colour").cast("long"))
    both = F.when(far, F.raise_error(F.lit("a fragment's depth is beyond 2147483"))).otherwise(both)
    packed = fragments.groupBy(*keys).agg(F.min(both).alias("p"))
    colour = F.pmod("p", F.lit(C.U32))
    return packed.select(*keys, ((F.col("p") - colour) / F.lit(C.U32) / 1000.0).alias("depth"), colour.alias("colour"))


def smooth_colours(fragments: DataFrame, pixels: int, tolerance: float = 1.01, keys: tuple[str, ...] = ("ix", "iy")) -> DataFrame:
    """Of each pixel the mean colour of the fragments at up to tolerance times the least depth.

    The least depths are at most one row per pixel of the picture, which is broadcast if the picture is not too large; then no fragment is
    shuffled, and a pixel with very many of them is no skew.
    """
    front = fragments.groupBy(*keys).agg(F.min("depth").alias("front"))
    front = F.broadcast(front) if pixels <= BROADCAST_PIXELS else front
    near = fragments.join(front, list(keys)).filter(F.col("depth") < F.col("front") * tolerance)
    return mean_colour(near, *keys)


def textures(points: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """Mean colour by texel (px, py, tx, ty) of patches that are known, where more than least points fall."""
    return mean_colour(points, "px", "py", "tx", "ty").filter(F.col("n") > least).join(known.select("px", "py"), ["px", "py"], "left_semi")


#: Ranges of values that are counted at once.
RANGES = 1024


def upper_median(df: DataFrame, value: str, weight: Column | None = None) -> DataFrame:
    """The middle value, the upper one of an even number, each value counted weight times; ties are equal values, so their order doesn't matter.

    Values are counted first, then the counts of so many equal ranges between the least and the greatest value say in which one the middle lies, and only
    the values of that range are ordered, again by ranges, until these hold one value. Each pass sees a bounded number of ranges on the driver.
    """
    counted = df.filter(F.col(value).isNotNull()).groupBy(value).agg((F.count("*") if weight is None else F.sum(weight)).cast("long").alias("c"))
    low, high, n = counted.agg(F.min(value), F.max(value), F.sum("c")).first()
    before, some = 0, counted
    while n and low < high:
        # halves, as the difference of far values is no double
        step = (high / 2 - low / 2) / RANGES
        at = F.least(F.greatest(F.floor((F.col(value) / 2 - F.lit(low / 2)) / F.lit(step)), F.lit(0)), F.lit(RANGES - 1))
        ranges = some.groupBy(at.alias("at")).agg(F.sum("c").alias("c"), F.min(value).alias("low"), F.max(value).alias("high"))
        for r in sorted(ranges.collect()):  # RANGES rows at most
            if before + r["c"] > n // 2:
                break
            before += r["c"]
        if (r["low"], r["high"]) == (low, high):  # some RANGES doubles at most lie between them, too near to each other to be told apart by ranges
            for v, c in sorted((x[value], x["c"]) for x in some.collect()):
                low = high = v
                if before + c > n // 2:
                    break
                before += c
            break
        low, high = r["low"], r["high"]
        some = some.filter(F.col(value).between(low, high))
    return df.sparkSession.createDataFrame([(low if n else None,)], "median double")


def progress(expected: DataFrame, loaded: DataFrame, key: str, group: str) -> DataFrame:
    """By group: how many keys (with column expected) there are, how many are fully loaded and whether all are."""
    have = loaded.groupBy(key).agg(F.count("*").alias("loaded"))
    done = F.coalesce("loaded", F.lit(0)) >= F.col("expected")
    return expected.join(have, key, "left").groupBy(group).agg(F.count("*").alias("parts"), F.sum(done.cast("int")).alias("parts_done"), F.bool_and(done).alias("complete"))


def summary(durations: DataFrame, group: list[str], value: str, amount: str) -> DataFrame:
    """Least, greatest and mean duration and the throughput by group."""
    return durations.groupBy(*group).agg(F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"), (F.sum(amount) / F.sum(value)).alias("throughput"))


def fraction(a: Column, b: Column) -> Column:
    return a / F.when(b != 0, b)
