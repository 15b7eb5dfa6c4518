"""Connected components of a graph of links, by rounds of joins.

Large-star and small-star rounds (Kiveris et al., 2014): neighbours move to the smallest node that is
known nearby, so the number of links never grows and the rounds are few. They end as soon as all links
form stars around their smallest nodes. Nothing is collected; every round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecmill.session import cut_lineage

MOST_ROUNDS = 60


def settled(links: DataFrame) -> bool:
    """Whether distinct ``links`` with ``u > v`` are stars: every ``u`` has one ``v``, and none is another's ``v``."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("out")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("out")))
    nodes = ends.groupBy("node").agg(F.sum("out").alias("out"), F.min("out").alias("least"))
    return nodes.where("out > 1 or out = 1 and least = 0").count() == 0


def components(links: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """``node, component`` for every node of a link; the component is its smallest node.

    Links may be repeated, in either direction, or from a node to itself; a node that is only linked
    with itself is left out.
    """
    pairs = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u != v")
    star = cut_lineage(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(MOST_ROUNDS):
        if settled(star):
            roots = star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        # Large star: a node's larger neighbours point to its smallest neighbour, or to it.
        both = star.unionByName(star.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: a node's smaller neighbours, and the node, point to the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()
        star = cut_lineage(small, "links")
    raise RuntimeError("components did not settle")
