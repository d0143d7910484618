"""Connected components of links too many for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.plans.scratch import written


def components(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """``node, root``: the least node of each node's component, for the nodes of ``links`` (u, v).

    Each round hangs every node's larger neighbours under its least one, then
    every node's smaller neighbours; depth halves at least, so ``max_rounds`` is
    beyond any graph, and a graph that isn't settled then is an error.
    """
    now = written(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = written(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        if new.exceptAll(now).limit(1).count() == 0 and now.exceptAll(new).limit(1).count() == 0:
            return new.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        now = new
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
