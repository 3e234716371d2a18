"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimlens.llm.tables import checkpointed

# Links of one part of a round's tables, and the least number of parts. A checkpoint makes a file for every part, filled or
# not, and on local disks Hadoop starts a process for each file, so small tables stay in few parts.
PART = 5_000
LEAST_PARTS = 4


def _kept(df: DataFrame, links: int) -> DataFrame:
    return checkpointed(df.coalesce(max(LEAST_PARTS, -(-links // PART))))


def _least_neighbour(edges: DataFrame, links: int) -> DataFrame:
    # Kept apart, so that the join below meets two plain shuffles and a hub's edges can be split.
    return _kept(edges.groupBy("u").agg(F.min("v").alias("m")), links)


def _state(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``component`` (its least reachable node) of every node of ``links`` (u, v).

    Each round joins every node's larger neighbours to its least one and then its smaller neighbours too, until
    nothing changes; the rounds grow with the logarithm of the longest path. Loops and repeated links are ignored.
    """
    edges = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct()
    edges = checkpointed(edges)
    before = _state(edges)
    while before[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (
            both.join(_least_neighbour(both, before[0]), "u")
            .where("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
            .distinct()
        )
        large = _kept(large, before[0])
        least = _least_neighbour(large, before[0])
        joined = large.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = _kept(joined.union(least.select("u", F.col("m").alias("v"))).distinct(), before[0])
        after = _state(edges)
        if after == before:
            break
        before = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
