"""Connected components by alternating large-star and small-star rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parlance.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Large: every greater neighbour of a node is linked to the least of the node and its neighbours. Small: every lesser one, and the node."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        out = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """From (a long, b long) links: (node, root), one row for each node that has a link to another; root is the least node of its component.

    Null ends and loops are ignored, repeated links count once, no links give no rows. Every round is
    stored in the shared folder, so that lineage stays short and lost executors are no matter. It ends
    when a round changes nothing, after about the logarithm of the longest path in rounds.
    """
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        mark = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if (mark["n"], mark["x"]) == state or not mark["n"]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        state = (mark["n"], mark["x"])
        now = stored(_star(_star(now, True), False), "links")
