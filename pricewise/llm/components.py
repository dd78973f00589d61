"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricewise.session import materialize


def _star(edges: DataFrame) -> DataFrame:
    """For each node ``u`` of ``edges`` (u, v): its smallest neighbour, itself included."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.join(_star(both), "u").filter("v > u")
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _star(down)
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b long): the root is the smallest node
    of the component.  Every round is written to the shared folder (lineage stays short, a
    lost executor costs nothing) and ends when a round changes nothing; the number of
    rounds grows with the logarithm of the longest chain.  A star's centre may be linked to
    very many nodes: sums are partial per task and the joins can be split by AQE."""
    links = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).filter("u <> v").distinct()
    links = materialize(links, "links")
    mark = _mark(links)
    while True:
        links = materialize(_small(_large(links)), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")) \
        .unionByName(links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _mark(links: DataFrame) -> tuple:
    """Order-free digest of an edge set."""
    h = F.xxhash64("u", "v")
    return tuple(links.agg(F.count("*"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_xor(h)).first())
