"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemospark.session import materialised


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is hung on the node's least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are hung on the least of them; u > v throughout."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    others = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return others.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """id, component (its least reachable id) of every node with an edge (u, v) to another.

    Edges are long ids; repeated edges, either direction and loops may occur, null
    ends are left out. No neighbours are ever gathered in one row: a hub costs
    as much as any other edges. The rounds grow with the log of the diameter.
    """
    current = materialised(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    mark = _mark(current)
    while mark[0]:
        current = materialised(_small_star(_large_star(current)))
        now = _mark(current)
        if now == mark:
            break
        mark = now
    roots = current.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return current.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
