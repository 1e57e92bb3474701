"""Connected components by alternating large-star and small-star joins, written out between rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import delete, write_out


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour larger than a node is tied to the smallest of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them. edges: u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    tied = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """links(u long, v long) -> (node, root): each node that has a link to another, with the smallest node it reaches.

    Rounds end when the edges stay the same: their number and the sum of their hashes are compared. No
    step holds a component in one task: minima are partial sums and the joins' hot sides can be split."""
    edges = links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    (edges, path), before = write_out(edges), None
    while True:
        sums = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if sums["n"] == 0 or sums == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = sums
        old = path
        edges, path = write_out(_small_star(_large_star(edges)).distinct())
        delete(links.sparkSession, old)  # no later step reads the round before
