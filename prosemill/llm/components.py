"""Connected components of links, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_by_key, written


def components(links: DataFrame) -> DataFrame:
    """links (a, b) to rows (node, root): every linked node with the least node that it reaches.

    Large-star and small-star rounds in turn (Kiveris et al., 2014): each hands a node's neighbours to their least one. A
    round is two grouped minima and two joins over the links, written to the shared folder; nothing is collected but a count
    and a checksum. A node with very many links is joined where its links are. Null ends and loops are left out; an empty
    table gives an empty result.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("a is not null and b is not null and a <> b").distinct()
    before, size = None, links.count()
    while True:
        # small_star has at most as many links as large_star, and that no more than there were.
        edges = written(small_star(large_star(edges, size), size), "components", size)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before, size = now, now[0]


def large_star(edges: DataFrame, size: int) -> DataFrame:
    """Each node links its larger neighbours to the least of its neighbours and itself; size: at least the number of edges."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return joined_by_key(both.filter("v > u"), least, "u", "n", 2 * size).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame, size: int) -> DataFrame:
    """Each node links its smaller neighbours and itself to the least of them; edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
    moved = joined_by_key(edges, least, "u", "n", size).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
