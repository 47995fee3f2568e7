"""Connected components by alternating label propagation and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import dropped, stored


def components(edges: DataFrame, rounds: int = 60, keep: list[str] | None = None) -> DataFrame:
    """(node, root) for each node of edges (a, b): root is the least node that links reach.

    Each round every node takes the least root among its neighbours' and its own, and
    then its root's root. It ends when no root changes; tables of each round are stored
    and the last but one deleted.
    """
    spark = edges.sparkSession
    paths: list[str] = []
    base: list[str] = []
    both = stored(edges.select("a", "b").where("a <> b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b")).distinct(), base)
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("root")), paths)
    for _ in range(rounds):
        near = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hop = labels.join(near, "node").select("node", F.least("root", "near").alias("to"), F.col("root").alias("old"))
        jump = hop.join(labels.select(F.col("node").alias("to"), F.col("root").alias("far")), "to", "left").select("node", F.least("to", F.coalesce("far", "to")).alias("root"), (F.least("to", F.coalesce("far", "to")) < F.col("old")).alias("moved"))
        new: list[str] = []
        out = stored(jump, new)
        moved = out.where("moved").limit(1).count()
        labels = out.select("node", "root")
        dropped(spark, paths)
        paths = new
        if not moved:
            dropped(spark, base)
            if keep is not None:
                keep += paths
            return labels
    raise RuntimeError(f"components are not settled after {rounds} rounds")
