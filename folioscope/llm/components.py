"""Connected components of a distributed edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_durable, durable


def _stars(edges: DataFrame) -> DataFrame:
    """Large star, then small star: every node ends up nearer to the least node it can reach.

    The least neighbour is a partial aggregation; only the join back sees a hub's edges together, and a sort-merge
    join of two shuffled sides is one that adaptive execution splits when a key is hot.
    """
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = large.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    small = down.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
    return small.select("e.u", "e.v").filter("u <> v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs to (u, v): v the least node of u's component, one row for each node that isn't the least.

    Runs until nothing changes (a number of rounds logarithmic in the component's size); each round's edges are a
    written table, so a lost executor costs one round's tasks. An empty table gives an empty table.
    """
    now = durable(edges.filter("u <> v").select("u", "v").distinct(), "edges")
    seen = _digest(now)
    while True:
        new = durable(_stars(now), "stars")
        drop_durable(now)
        now, last = new, seen
        if (seen := _digest(now)) == last:
            return now
