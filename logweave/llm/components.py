"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.llm.common import cut


def _stars(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest node among u and the partners of u."""
    low = pairs.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return pairs.join(low, "u")


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows (node, root): for each node of ``edges`` (u, v; integers of one
    total order) the smallest node of its component.

    Each round hangs larger neighbours on the smallest neighbour (large star)
    and then flattens (small star); both steps are a grouped minimum, which
    combines before its shuffle, and a join that adaptive execution splits on
    hot nodes.  Rounds are checkpointed.  Self loops and null ends are dropped;
    no edges give no rows.
    """
    now = cut(edges.select("u", "v").where("u is not null and v is not null and u <> v")
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    if not state[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(max_rounds):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = (_stars(both).where("v > u")
                 .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = _stars(large)
        now = cut(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                  .union(small.select("u", F.col("m").alias("v"))).distinct())
        before, state = state, _state(now)
        if before == state:
            roots = now.select(F.col("v").alias("node")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                roots.select("node", F.col("node").alias("root")))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
