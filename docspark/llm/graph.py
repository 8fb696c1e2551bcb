"""Connected components by alternating large-star and small-star steps.

All work is joins and grouped minima over the edge table; nothing is gathered on
the driver but a count and a checksum a round. A root with very many neighbours
meets in a grouped minimum, which Spark sums up before its shuffle, and in an
equi-join, which adaptive execution splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import frames


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the smallest node it reaches. Loops and repeated edges do no harm."""
    stars = frames.cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    state = _state(stars)
    while True:
        both = stars.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(stars.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e"))
        stars = frames.cut(small.select("e.*").filter("hi <> lo").distinct())
        now = _state(stars)
        if now == state:
            break
        state = now
    return stars.select(F.col("hi").alias("node"), F.col("lo").alias("root")).union(stars.select("lo", "lo").distinct())


def _state(stars: DataFrame) -> tuple:
    return tuple(stars.agg(F.count("*"), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first())
