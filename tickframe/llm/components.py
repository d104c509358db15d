"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickframe.llm.common import few_files, stored


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def _least(arcs: DataFrame) -> DataFrame:
    """The smaller of a node and its smallest neighbour; partial minima meet before the shuffle."""
    return arcs.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("n"), F.least("u", "v").alias("m"))


def components(edges: DataFrame, about: int | None = None) -> DataFrame:
    """``node, root`` for every node with an edge; root is the component's smallest node.

    ``edges`` has ``u`` and ``v``, and ``about`` so many rows if that is known. Large-star and small-star rounds: each round hangs a node's
    larger (then smaller) neighbours below the smallest one, until only stars are left. Joins
    are on a node, so Spark can split those with many edges; no neighbourhood is collected.
    Each round is written to the shared folder, in files by its number of edges: no star has more
    edges than it was made from.
    """
    edges = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    edges = stored(edges if about is None else few_files(edges, about), "edges")
    before = _mark(edges)
    while True:
        arcs = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = arcs.join(_least(arcs), F.col("u") == F.col("n")).filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(few_files(large, before[0]), "large_star")  # every node points to a smaller one
        least = _least(large)
        small = large.join(least, F.col("u") == F.col("n")).filter("v > m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v"))).filter("u > v").distinct()
        edges = stored(few_files(small, before[0]), "small_star")
        after = _mark(edges)
        if after == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = after
