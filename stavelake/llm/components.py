"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release


def components(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): the least node that links reach.

    Each round points neighbours to the least node around them; paths shorten at least by
    half, so rounds grow with the logarithm of the longest path. Node values need only an
    order. A star of any size is pairs with its centre, never a list in one row. Nulls and
    links to itself are left out.
    """
    edges = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(rounds):
        # large star: neighbours above a node point to the least around it
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: neighbours below a node, and the node itself, point to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialize(small.unionAll(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        same = after.count() == edges.count() and after.exceptAll(edges).isEmpty()
        release(edges)
        edges = after
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
