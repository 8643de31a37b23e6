"""Connected components of a link table, without gathering links anywhere.

Alternating large-star and small-star steps (Kiveris et al., 2014).  Every step
is two shuffles of the remaining links, each written to the shared folder, so that plans
stay short; the number of steps grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from treeline.llm.shared import beside, staged


def _star(links: DataFrame, small: bool) -> DataFrame:
    """Links each node's neighbours (larger ones, or for ``small`` the smaller) to its least neighbour."""
    sides = links if small else links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = sides.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).withColumn("m", F.least("u", "m"))
    joined = beside(sides, least, "u")
    if small:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    else:
        moved = joined.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the links ``(a, b)``; ``root`` is the least node of its component."""
    links = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    shape = None
    while True:
        links = staged(_star(links, small=False), "links")
        links = staged(_star(links, small=True), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == shape:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        shape = now
