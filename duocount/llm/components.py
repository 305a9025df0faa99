"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duocount.session import cut_lineage


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point every node's larger (large) or smaller (small) neighbours, and itself, at its least one.

    Minima are a partial aggregate joined back on the node, so a node of any degree is never gathered
    in one place."""
    both = edges.select("u", "v").union(edges.select("v", "u")).where("u <> v")
    if large:
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    down = both.where("v < u")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) of every node on an edge (u, v); the label is the least node it can reach.

    Each round is written to the checkpoint folder; ends when a round changes nothing, which takes
    about log2 of the longest path's length."""
    now = cut_lineage(edges.select("u", "v").where("u <> v").distinct(), "edges")
    mark = None
    for _ in range(rounds):
        now = cut_lineage(_star(_star(now, True), False), "edges")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        if state == mark:
            break
        mark = state
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select("v", "v").distinct())
