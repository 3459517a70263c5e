"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from modspark.session import materialise


def _minima(edges: DataFrame, key: str, other: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("node")).agg(F.min(other).alias("least"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour that is larger than a node moves to the least one around that node."""
    both = edges.unionByName(edges.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
    least = _minima(both, "hi", "lo").select("node", F.least("node", "least").alias("least"))
    return both.join(least, F.col("hi") == F.col("node")).where("lo > hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours move to the least of these."""
    least = _minima(edges, "hi", "lo")
    moved = edges.join(least, F.col("hi") == F.col("node")).where("lo <> least").select(F.col("lo").alias("hi"), F.col("least").alias("lo"))
    return moved.unionByName(least.select(F.col("node").alias("hi"), F.col("least").alias("lo"))).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) of every node that has a link: the smallest node it can reach.

    links: two long columns, in either order, repeats allowed; rows with a null or with the
    same node twice say nothing. No links give no rows. Each round is a table in the shared
    folder, and the rounds end when one changes nothing. A round moves each link once, so
    work follows the number of links, not the number of pairs that they connect.
    """
    edges = materialise(links.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).where("hi > lo").distinct())
    mark = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("hi", "lo")).alias("x"))
    before = None
    while True:
        now = edges.select(mark.alias("m")).first()["m"]
        if now == before or not now["n"]:
            break
        before = now
        edges = materialise(_small_star(_large_star(edges)))
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("component")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("component")).distinct())
