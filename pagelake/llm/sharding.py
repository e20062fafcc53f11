"""Hierarchical weighted hash tree: rows descend region, rack and shard by weighted hash draws.

A row draws ln(u)/weight for a shard, u a hash of its key, the shard and a seed. The draw of a rack or
region is the largest of the shards below it: that is distributed as one draw of their whole weight, and
it depends on that subtree alone. At each level the row takes the child of the largest draw. So when a
weight grows, rows move into that shard only, and when it shrinks, out of it only; movement stays in the
subtrees whose weights change. ``tree(n + 1)`` is ``grow(tree(n))``, and one more shard takes rows only
into itself.

Defined cases: a null key is a key like any other; equal keys get one shard; an empty table gives an
empty result; other columns of the table are neither read nor returned.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.llm.common import gapless_rank, small_key_counts, table


@dataclass(frozen=True)
class Node:
    """A region, rack or shard. ``key`` names a shard in the draws; shards carry their number."""

    key: int
    weight: float = 0.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @property
    def total(self) -> float:
        return self.weight if self.shard is not None else sum(c.total for c in self.children)


def tree(shards: int, per_rack: int = 2, racks_per_region: int = 2, weight: float = 1.0) -> Node:
    """Shards 0..n-1 of equal weight, filled rack by rack and region by region."""
    return _filled([Node(3_000_000 + i, weight, (), i) for i in range(shards)], per_rack, racks_per_region)


def _filled(leaves: list[Node], per_rack: int, racks_per_region: int) -> Node:
    shards = len(leaves)
    racks = [Node(2_000_000 + i, children=tuple(leaves[i : i + per_rack])) for i in range(0, shards, per_rack)]
    regions = [Node(1_000_000 + i, children=tuple(racks[i : i + racks_per_region])) for i in range(0, len(racks), racks_per_region)]
    return Node(0, children=tuple(regions))


def grow(root: Node, per_rack: int = 2, racks_per_region: int = 2, weight: float = 1.0) -> Node:
    """One more shard, in the next free place: rows move only into it."""
    leaves = sorted(leaves_of(root), key=lambda x: x.shard)
    n = 1 + leaves[-1].shard
    return _filled([*leaves, Node(3_000_000 + n, weight, (), n)], per_rack, racks_per_region)


def leaves_of(node: Node) -> list[Node]:
    return [node] if node.shard is not None else [x for c in node.children for x in leaves_of(c)]


def place(key: Column, root: Node, seed: int = 0) -> Column:
    """The shard of ``key``. A level costs one draw for each shard below the node reached."""

    def draw(child: Node) -> Column:
        if child.shard is None:
            below = [draw(x) for x in child.children if x.total > 0]
            return F.greatest(*below) if len(below) > 1 else below[0]
        u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(child.key), key), 11) + F.lit(0.5)) * F.lit(2.0**-53)
        return F.log(u) / F.lit(float(child.weight))

    def descend(node: Node) -> Column:
        if node.shard is not None:
            return F.lit(node.shard)
        able = [c for c in node.children if c.total > 0]
        if len(able) == 1:
            return descend(able[0])
        best = F.array_max(F.array(*[F.struct(draw(c).alias("d"), F.lit(-i).alias("i")) for i, c in enumerate(able)])).getField("i")
        out = F.when(best == 0, descend(able[0]))
        for i, c in enumerate(able[1:], 1):
            out = out.when(best == -i, descend(c))
        return out

    return descend(root).cast("int")


def assign(docs: DataFrame, root: Node, key: str = "doc_id", out: str = "shard") -> DataFrame:
    return docs.withColumn(out, place(F.col(key), root))


def op1_hash_tree(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    root = tree(shards)
    placed = assign(docs, root)
    counts = small_key_counts(assign(table(spark, sf_dir, "documents").select("doc_id"), root), "shard", shards)
    ranked = gapless_rank(placed, "shard", counts, ["doc_id", "text_crc32", "size"], "slot")
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), place(F.col("doc_id"), grow(root)).alias("grown_shard"))


def expected_share(root: Node) -> dict[int, float]:
    """Each shard's share of the rows: the product of weight shares on its way down."""
    total = root.total
    return {x.shard: (x.total / total if total else math.nan) for x in leaves_of(root)}
