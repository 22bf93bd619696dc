"""Connected components of an edge table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..runtime import materialize


def _pairs(a, b) -> list:
    """The larger end first."""
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above u is linked to the smallest of u and its neighbours.

    The minima are stored, so that the join reads two plain exchanges and Spark can split a hot node.
    """
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(
        F.col("u").alias("n"), F.least("u", "m").alias("m")))
    return both.join(least, F.col("u") == F.col("n")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every neighbour below u, and u itself, is linked to the smallest of them."""
    edges = materialize(edges.distinct())
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "n"))
    joined = edges.join(least, F.col("u") == F.col("n")).where("v <> m").select(*_pairs(F.col("v"), F.col("m")))
    return joined.union(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable from it.

    Edges may repeat, link a node to itself or hold nulls, which are ignored; a node that has only such edges
    is not returned. Each round groups and joins edges, never gathering a node's neighbours, and stores the
    result; the number of edges does not grow from round to round.
    """
    now = materialize(edges.where(F.col(a) != F.col(b)).select(*_pairs(F.col(a), F.col(b))).distinct())
    mark = _fingerprint(now)
    while mark[0]:
        now = materialize(_small_star(_large_star(now)))
        before, mark = mark, _fingerprint(now)
        if mark == before:
            break
    roots = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("node"), F.col("v").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def _fingerprint(edges: DataFrame):
    """Equal for equal sets of edges; only two numbers come to the driver."""
    return edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
