"""Connected components of a graph by alternating star contraction.

Large-star links every larger neighbour of a node to the smallest one, small-star every smaller
neighbour; both keep connectivity, and after a logarithmic number of rounds each node hangs directly
below the smallest of its component (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014). Minima are combined before the shuffle and nothing gathers the neighbours of a node.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import settle
from .joins import spread_join


def _star(pairs: DataFrame) -> DataFrame:
    """Every pair with the smallest neighbour of its ``u``, or ``u`` itself if smaller."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    return spread_join(pairs, least, "u")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    stars = _star(both).filter(F.col("v") > F.col("u"))
    return stars.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges come as (larger, smaller), which is what large-star returns."""
    stars = _star(edges)
    tops = F.struct(F.col("u").alias("u"), F.col("m").alias("v"))
    rest = F.struct(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = stars.select(F.explode(F.array(tops, rest)).alias("e")).select("e.u", "e.v")
    return moved.filter(F.col("u") != F.col("v")).distinct()


def _digest(edges: DataFrame) -> tuple:
    mark = F.xxhash64("u", "v")
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(mark).alias("x"), F.bit_xor(F.xxhash64(mark)).alias("y"))
    return tuple(row.first())


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the edges ``(u, v)``; root is the smallest node reachable.

    Self-loops and repeated edges are harmless; no edges give no rows. Each round is written to the
    shared folder, so that a lost executor costs a task and not the rounds before.
    """
    larger, smaller = F.greatest("u", "v"), F.least("u", "v")
    edges = edges.filter(F.col("u") != F.col("v"))
    edges = settle(edges.select(larger.alias("u"), smaller.alias("v")).distinct())
    seen = _digest(edges)
    while seen[0]:
        edges = settle(_small_star(_large_star(edges)))
        now = _digest(edges)
        if now == seen:
            break
        seen = now
    tops = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return tops.union(roots)
