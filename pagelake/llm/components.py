"""Connected components by alternating stars, all in tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.llm.common import cut, free


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (u, v long): root is the smallest node reachable.

    A round links each node's larger neighbours to its smallest one, then each node's smaller
    neighbours and itself to the smallest; rounds end when the edges stay the same, after about the
    logarithm of the number of nodes. Minima are combined before they are dealt out, and a node of
    many edges only meets one row, so a join can split it.
    """
    now = cut(edges.select(F.greatest("u", "v").alias("x"), F.least("u", "v").alias("y")).filter("x > y").distinct())
    if not now.limit(1).count():
        return now.toDF("node", "root")
    mark = None
    for _ in range(most_rounds):
        both = now.select(F.col("x").alias("u"), F.col("y").alias("v")).unionByName(now.select(F.col("y").alias("u"), F.col("x").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").filter("v > m").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        large = cut(large)
        free(now)
        small = large.groupBy("x").agg(F.min("y").alias("m"))
        joined = large.join(small, "x")
        new = joined.filter("y > m").select(F.col("y").alias("x"), F.col("m").alias("y")).unionByName(small.select("x", F.col("m").alias("y"))).distinct()
        now = cut(new)
        free(large)
        row = now.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("x", "y")).alias("h")).first()
        if mark == (row["n"], row["h"]):
            break
        mark = (row["n"], row["h"])
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("x").alias("node"), F.col("y").alias("root")).unionByName(now.select(F.col("y").alias("node"), F.col("y").alias("root")).distinct())


def merged(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root of ``roots`` (as ``components`` gives them) after further ``edges`` (u, v long).

    The edges are taken between roots, so the work is that of the new edges and not of all before.
    """
    at = lambda df, x: df.join(roots.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")), x, "left").withColumn(x, F.coalesce(f"r{x}", x)).drop(f"r{x}")
    moved = components(at(at(edges.select("u", "v"), "u"), "v"))
    now = roots.join(moved.toDF("root", "to"), "root", "left").select("node", F.coalesce("to", "root").alias("root"))
    return cut(now.unionByName(moved.join(roots, "node", "left_anti")))
