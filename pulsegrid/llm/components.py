"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import written

#: Links of a written file; a round never has more links than the one before it.
LINKS_PER_FILE = 200_000


def _minima(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _settled(stars: DataFrame) -> bool:
    """Whether every node has one link, to a node that has none: the links are stars around the least nodes."""
    if (stars.groupBy("u").count().agg(F.max("count")).first()[0] or 1) > 1:
        return False
    return stars.select("v").join(stars.select(F.col("u").alias("v")), "v", "left_semi").count() == 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``: component is the least node reachable.

    Self links and repeated links are allowed; rows with a null end are ignored; an empty table gives none.
    Each round is two aggregations with partial sums and two joins on nodes (which adaptive execution splits
    where a node is hot); the links shrink to stars in a logarithmic number of rounds, and tables are written in files of some LINKS_PER_FILE links. Only
    counts reach the driver.
    """
    plain = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u is not null and v is not null and u <> v")
    stars = written(plain.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _settled(stars):
            break
        files = 1 + stars.count() // LINKS_PER_FILE
        both = stars.union(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.filter("v > u").join(_minima(both), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _minima(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = written(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(files), "links")
    else:
        raise RuntimeError("the components did not settle")
    nodes = stars.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
