"""Connected components by alternating large and small stars, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.tables import written


def _signature(edges: DataFrame):
    row = edges.agg(
        F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))
    ).first()
    return tuple(row)


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    met = edges.join(least, "u")
    own = least.select("u", F.col("m").alias("v"))
    return own.unionByName(
        met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    )


def connected_components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node`` and ``root`` (the smallest node reachable) for each node of a link.

    Links from a node to itself, repeated links and links with a NULL end add nothing. The rounds
    grow with the logarithm of the longest path; what comes to the driver is one count and one
    checksum per round."""
    links = edges.where(F.col(left) != F.col(right)).select(
        F.greatest(left, right).alias("u"), F.least(left, right).alias("v")
    )
    current = written(links.distinct(), "links")
    before = _signature(current)
    while before[0]:
        current = written(
            _small_star(written(_large_star(current).distinct(), "stars")).distinct(), "links"
        )
        now = _signature(current)
        if now == before:
            break
        before = now
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
