"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.plans.storage import through_files


def _stars(pairs: DataFrame) -> DataFrame:
    """Adds to (u, v) the smallest of u and all its v.

    The minimum is combined before the shuffle, and the join back lets adaptive execution
    split a vertex with very many neighbours.
    """
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) for every vertex of the (u, v) edges; component is the smallest id reachable.

    Each pair of rounds links all neighbours of a vertex to the smallest one; the edges stop
    changing when each component is a star around its smallest vertex, after a number of
    rounds that grows with the logarithm of the size.  Rounds go through written tables.
    """
    e = through_files(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    )
    mark = None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _stars(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        starred = _stars(large)
        small = starred.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            starred.select("u", F.col("m").alias("v"))
        )
        e = through_files(small.filter("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )
