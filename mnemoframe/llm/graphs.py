"""Connected components over an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import materialize


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """``edges`` (u, v) with m: the least of u and all v of the same u. Two steps, so that a node with many neighbours is pre-aggregated and its rows can be split."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, name: str = "components", max_rounds: int = 60) -> DataFrame:
    """(node, root) for each node of ``edges`` (u, v: bigint); root is the least node of its component.

    Each round is written to the shared folder. Ends when a round leaves the edges as they were.
    """
    now = materialize(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    before = None
    for _ in range(max_rounds):
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _least_neighbour(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small = _least_neighbour(large)
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        now = materialize(star, name)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen
    raise RuntimeError(f"no end after {max_rounds} rounds")
