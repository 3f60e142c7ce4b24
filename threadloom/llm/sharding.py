"""Sharding by a hierarchical weighted hash tree."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import scaled


@dataclass
class Node:
    """A region, rack or (without children) a shard."""

    name: str
    weight: float = 1.0
    children: list["Node"] = field(default_factory=list)
    shard: int | None = None

    def total(self) -> float:
        return sum(c.total() for c in self.children) if self.children else self.weight


def tree_for(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Node:
    """Shards 0..n-1 of weight 1 in racks in regions, filled in order."""
    leaves = [Node(f"s{i}", shard=i) for i in range(shards)]
    racks = [Node(f"k{i}", children=leaves[i * per_rack : (i + 1) * per_rack]) for i in range(-(-shards // per_rack))]
    n = -(-len(racks) // racks_per_region)
    return Node("root", children=[Node(f"r{i}", children=racks[i * racks_per_region : (i + 1) * racks_per_region]) for i in range(n)])


def grown(root: Node, shard: int, weight: float = 1.0) -> Node:
    """One more shard, as a region of its own: no other subtree's weight
    changes, so rows move into the new shard and nowhere else."""
    leaf = Node(f"s{shard}", weight, shard=shard)
    return Node(root.name, children=[*root.children, Node(f"r+{shard}", children=[Node(f"k+{shard}", children=[leaf])])])


def _draw(key: Column, node: Node) -> Column:
    """Weighted rendezvous draw: an exponential clock of rate ``weight``; the
    smallest wins, with probability in proportion to the weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(node.name)), 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(u) / F.lit(float(node.total()))


def shard_of(key: Column, node: Node) -> Column:
    """Descend from ``node``: at each level the child with the smallest draw."""
    if node.shard is not None:
        return F.lit(node.shard)
    live = [c for c in node.children if c.total() > 0]
    if len(live) == 1:
        return shard_of(key, live[0])
    best = F.least(*[_draw(key, c) for c in live])
    out = None
    for c in live:
        hit = _draw(key, c) == best
        out = F.when(hit, shard_of(key, c)) if out is None else out.when(hit, shard_of(key, c))
    return out


def hash_tree_shards(docs: DataFrame, root: Node, more: Node | None = None, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 20_000) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` for every row.

    The shard follows from the id and the tree alone (law ``key``). A change of
    weights moves rows only into and out of subtrees whose weight changes;
    ``more`` is the tree after growth (``grown``).

    ``slot`` numbers the rows of a shard from 0 without gaps, in two levels:
    rows are ranked inside hash buckets of a shard, and a bucket's first slot
    comes from the buckets' counts. No task holds a shard, however large.

    Nulls: a null id is a key like any other; a null text has size 1 and
    checksum 0. Repeated rows get the same shard and slots of their own.
    """
    key = F.col(id_col).cast("string")
    n = scaled(docs.count(), per_bucket, 16, 1 << 14)
    base = docs.withColumns({"_s": shard_of(key, root), "_b": F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(n)).cast("int")})
    counts = base.groupBy("_s", "_b").count()  # reads the id column only; at most shards x n rows
    first = counts.select("_s", "_b", (F.sum("count").over(Window.partitionBy("_s").orderBy("_b")) - F.col("count")).alias("_first"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = base.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), "_s", "_b")
    rank = F.row_number().over(Window.partitionBy("_s", "_b").orderBy("doc_id", "size", "text_crc32")) - 1
    out = rows.withColumn("_rank", rank).join(first, [rows["_s"].eqNullSafe(first["_s"]), rows["_b"] == first["_b"]])
    moved = shard_of(F.col("doc_id").cast("string"), more) if more else F.lit(None).cast("int")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), rows["_s"].alias("shard"), (F.col("_first") + F.col("_rank")).alias("slot"), moved.alias("grown_shard"))
