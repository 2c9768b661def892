"""Connected components of a distributed edge table, by alternating large-star and small-star.

Both steps point vertices at the smallest neighbour they see (Kiveris et al., "Connected
Components in MapReduce and Beyond"). The smallest neighbour comes from a pre-aggregated
group-by and goes back to the edges by a join, so that a hub's edges are never one task's
group: Spark splits skewed partitions of such a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.llm.scratch import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """No vertex has two parents, and none is both a parent and a child."""
    ends = edges.select(F.col("a").alias("v"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(edges.select("b", F.lit(0), F.lit(1)))
    seen = ends.groupBy("v").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return seen.filter("child > 1 or (child = 1 and parent = 1)").isEmpty()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a long, b long) undirected links -> (id long, component_id long) for every linked id.

    component_id is the smallest id that can be reached. Loops, repeated links and links with a
    null end are ignored; no links give an empty table. The result is a written table.
    """
    now = scratch.keep(
        edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links"
    )
    while not _is_forest_of_stars(now):
        after = scratch.keep(_small_star(_large_star(now)), "stars")
        scratch.drop(now)
        now = after
    roots = now.select(F.col("b").alias("id")).distinct()
    found = scratch.keep(
        now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(roots.select("id", F.col("id").alias("component_id"))),
        "components",
    )
    scratch.drop(now)
    return found
