"""Connected components by alternating large-star and small-star steps.

Kiveris et al., "Connected Components in MapReduce and Beyond" (2014). Each
step is one min-aggregate and one join over the edges; neither collects the
neighbours of a node, so a hub costs rows, never one task's memory. Edges stay
in the cluster: the driver sees one count and one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.shared import Table


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = least.select("u", F.col("m").alias("v"))
    return moved.union(own).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, root) for every node on an edge; root is the least node.

    ``edges`` has long columns u and v. Self-loops, repeated edges and both
    directions of an edge are allowed; rows with a null end are ignored. An
    empty table gives an empty result.
    """
    start = edges.select("u", "v").filter("u is not null and v is not null and u <> v")
    table = Table(start.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = None
    while True:
        n, mark = table.df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if n == 0 or (n, mark) == seen:
            return table.df.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                table.df.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = (n, mark)
        following = Table(_small_star(_large_star(table.df)), "edges")
        table.drop()
        table = following
