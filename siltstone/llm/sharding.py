"""Sharding by a hierarchical weighted hash tree.

A row descends from the root through region, rack and shard. At each level
every child draws ln(u) / weight, with u in (0, 1] from a hash of the row's key
and the child's name, and the highest draw wins. The chance of a child is its
share of the weight at that level. A weight that changes alters only that
child's own draws, so rows move only into or out of the subtrees whose weights
changed; inside all others they stay.

A tree grows by a new region that holds the new shard alone. Its draws at the
top level can only attract rows, and all of them to that shard.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FOUNDING_SHARDS = 40
SHARDS_PER_RACK = 5
RACKS_PER_REGION = 2


@dataclass(frozen=True)
class Node:
    """A shard (no children) or a region or rack; its weight is that of its leaves."""

    name: str
    weight: float = 1.0
    children: tuple[Node, ...] = ()
    shard: int | None = None

    @staticmethod
    def over(name: str, children: tuple[Node, ...]) -> Node:
        return Node(name, sum(c.weight for c in children), children)


def founding_tree(shards: int = FOUNDING_SHARDS, weights: dict[int, float] | None = None) -> Node:
    """Regions of racks of shards, filled in order; shards weigh 1 unless ``weights`` says otherwise."""
    w = weights or {}
    leaves = [Node(f"s{i}", w.get(i, 1.0), (), i) for i in range(shards)]
    racks = [
        Node.over(f"k{i // SHARDS_PER_RACK}", tuple(leaves[i : i + SHARDS_PER_RACK]))
        for i in range(0, shards, SHARDS_PER_RACK)
    ]
    regions = [
        Node.over(f"r{i // RACKS_PER_REGION}", tuple(racks[i : i + RACKS_PER_REGION]))
        for i in range(0, len(racks), RACKS_PER_REGION)
    ]
    return Node.over("root", tuple(regions))


def grown(tree: Node, shard: int, weight: float = 1.0) -> Node:
    """The tree with one more shard, in a region and rack of its own."""
    leaf = Node(f"s{shard}", weight, (), shard)
    region = Node.over(f"r+{shard}", (Node.over(f"k+{shard}", (leaf,)),))
    return Node.over(tree.name, (*tree.children, region))


def tree_of(shards: int, founding: int = FOUNDING_SHARDS) -> Node:
    """The tree that ``shards`` alone decides: the founding tree, then one region for each further shard."""
    tree = founding_tree(min(shards, founding))
    for i in range(founding, shards):
        tree = grown(tree, i)
    return tree


def _levels(tree: Node) -> tuple[list[list[tuple[str, float, int]]], list[int | None]]:
    """Children (name, weight, number) of every node, numbered from the root, and the nodes' shards; weightless children are left out."""
    nodes, children = [tree], []
    for node in nodes:  # grows while it is read
        live = [c for c in node.children if c.weight > 0]
        children.append([(c.name, c.weight, len(nodes) + i) for i, c in enumerate(live)])
        nodes += live
    return children, [n.shard for n in nodes]


def descend(key: Column, tree: Node) -> Column:
    """The shard that a string key reaches: one draw among the children at each level."""
    children, shards = _levels(tree)
    kind = "array<array<struct<name:string,weight:double,node:int>>>"
    table = F.from_json(F.lit(json.dumps([[{"name": n, "weight": w, "node": i} for n, w, i in c] for c in children])), kind)

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), child["name"])), 1, 12), 16, 10).cast("double")
        return F.struct((F.log((bits + 1) / F.lit(float(2**48))) / child["weight"]).alias("draw"), (-child["node"]).alias("node"))

    depth, level = 0, [0]
    while any(shards[i] is None for i in level):
        level = [i for at in level for *_, i in children[at]]
        depth += 1
    node = F.lit(0)
    for _ in range(depth):
        node = -F.array_max(F.transform(F.element_at(table, node + 1), draw))["node"]
    return F.element_at(F.array(*(F.lit(s).cast("int") for s in shards)), node + 1)


def assign_shards(df: DataFrame, tree: Node, key: str = "doc_id", column: str = "shard") -> DataFrame:
    """Add the shard of each row: its key and the tree decide, nothing else. A null key counts as the word null."""
    return df.withColumn(column, descend(F.coalesce(F.col(key).cast("string"), F.lit("null")), tree).cast("int"))


def slots(df: DataFrame, key: str, tie: str, rows_per_block: int = 200_000) -> DataFrame:
    """Number the rows of each ``shard`` from 0 without gaps.

    Shards are cut into blocks by a hash of the key; a block's first slot is the
    count of the shard's rows in earlier blocks. No task holds a whole shard.
    """
    total = df.count()
    n = max(1, -(-total // rows_per_block))
    word = F.concat(F.lit("slot:"), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    block = F.conv(F.substring(F.md5(word), 1, 8), 16, 10).cast("long") % n
    rows = df.withColumn("_block", block)
    sizes = rows.groupBy("shard", "_block").count()
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("shard", "_block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_block").orderBy(key, tie)
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(starts, ["shard", "_block"])
        .withColumn("slot", (F.col("_start") + F.col("_rank") - 1).cast("long"))
        .drop("_block", "_rank", "_start")
    )


def shard_documents(docs: DataFrame, shards: int = FOUNDING_SHARDS) -> DataFrame:
    """Shard and slot of each document under the law ``key``, and its shard with one more shard.

    Output, a row for each input row: ``doc_id, size, text_crc32, law, shard,
    slot, grown_shard``. A null text has size 16 and the checksum of an empty
    text. A null ``doc_id`` counts as the key ``null``. Rows that repeat a
    ``doc_id`` share its shard and get slots of their own.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    rows = assign_shards(rows, tree_of(shards))
    rows = assign_shards(rows, tree_of(shards + 1), column="grown_shard")
    return slots(rows, "doc_id", "text_crc32").select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )
