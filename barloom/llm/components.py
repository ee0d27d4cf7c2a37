"""Connected components of links by alternating large and small stars.

Each round links every node's larger neighbours to the smallest of its neighbourhood, then its smaller
ones likewise. Only minima per node are aggregated, so a node with many links is combined before the
shuffle and no neighbourhood is ever collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import stored


def _star(both: DataFrame, side: str) -> DataFrame:
    """Rows u, v: link the neighbours v of u on one side of u to the least of u and its neighbours."""
    least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    joined = both.join(least, "u")
    if side == "large":
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _reverse(links: DataFrame) -> DataFrame:
    return links.select(F.col("v").alias("u"), F.col("u").alias("v"))


def components(links: DataFrame) -> DataFrame:
    """node, root of every node in `links` (u, v: any values that compare); root is the smallest node reachable.

    Null ends and loops are ignored. Without links there are no rows. Every round is written to the
    shared checkpoint folder.
    """
    kept = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        now = kept.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or now[0] == 0:
            return kept.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                kept.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        seen = now
        large = _star(kept.unionByName(_reverse(kept)), "large").distinct()
        kept = stored(_star(large, "small").where("u <> v").distinct())
