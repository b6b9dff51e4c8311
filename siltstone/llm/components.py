"""Connected components by alternating large-star and small-star.

Kiveris et al., "Connected Components in MapReduce and Beyond" (SoCC 2014).
Each step is a map-side combined minimum for each node and a join back, so a
hub with a third of all edges never meets in one group; the skewed side of the
join can be split by adaptive execution.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import Scratch


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    return tuple(row)


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """Rows ``(u, v)``: every node u that isn't the least of its component, and that least node v.

    ``edges`` has two bigint columns ``u`` and ``v`` in any direction; loops,
    repeats and null ends are ignored.
    """
    e = scratch.save(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
        "edges",
    )
    seen = _fingerprint(e)
    for _ in range(max_rounds):
        if not seen[0]:
            return e
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("n")).agg(F.least(F.min("v"), F.first("u")).alias("lo"))
        large = (
            both.where("v > u")
            .join(low, F.col("u") == F.col("n"))
            .select(F.col("v").alias("u"), F.col("lo").alias("v"))
            .distinct()
        )
        low = large.groupBy(F.col("u").alias("n")).agg(F.min("v").alias("lo"))
        small = (
            large.join(low, F.col("u") == F.col("n"))
            .select(F.col("v").alias("u"), F.col("lo").alias("v"))
            .where("u <> v")
            .unionByName(low.select(F.col("n").alias("u"), F.col("lo").alias("v")))
            .distinct()
        )
        new = scratch.save(small, "edges")
        now = _fingerprint(new)
        scratch.drop(e)
        e = new
        if now == seen:
            return e
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
