"""Connected components of a graph given as a table of links, by alternating stars.

Each round links every larger neighbour of a node to the node's smallest neighbour, then every
smaller one; a component of any shape becomes one star around its smallest node in about
log(size) rounds. Only minima are computed per node, combined before the shuffle, and every
round is cut by a table on shared storage. Nothing but two numbers a round reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanforge.llm.common import drop_stored, stored


def components(links: DataFrame) -> DataFrame:
    """``node, label`` of every node with a link; the label is the smallest node reachable.

    ``links`` has long columns ``u, v``; direction, repetition and loops do not matter.
    """
    edges = stored(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(),
        "links",
    )
    mark = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            small.select("u", F.col("m").alias("v"))
        )
        after = stored(small.filter("u > v").distinct(), "links")
        drop_stored(edges)
        edges, before = after, mark
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        mark = (row[0], row[1])
        if mark == before or row[0] == 0:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return ends.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())
