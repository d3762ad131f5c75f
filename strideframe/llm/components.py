"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strideframe.session import stage


def components(links: DataFrame) -> DataFrame:
    """node and label of every node of `links` (a, b: longs): equal labels where links connect them.

    Each round sends every node to the neighbour (or itself) that comes first in an order drawn anew for the round,
    and replaces nodes by where they went; the graph shrinks by a constant share a round in expectation, long chains
    included.  Rounds read and write staged tables, and neighbours are never gathered in a list.
    """
    both = links.where("a <> b").select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x"))
    edges = stage(both.select("x.*").distinct())
    labels, turn = stage(edges.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct()), 0
    while not edges.isEmpty():
        moves = stage(_moves(edges, turn))
        to = moves.select(F.col("a").alias("b"), F.col("to").alias("to_b"))
        edges = stage(edges.join(moves, "a").join(to, "b").where("to <> to_b").select(F.col("to").alias("a"), F.col("to_b").alias("b")).distinct())
        labels = stage(labels.join(moves, labels["label"] == moves["a"], "left").select("node", F.coalesce("to", "label").alias("label")))
        turn += 1
    return labels


def _moves(edges: DataFrame, turn: int) -> DataFrame:
    """a and to: where each node goes."""
    order = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("order"), F.col(c).alias("to"))
    return edges.groupBy("a").agg(F.min(order("b")).alias("first")).select("a", F.least("first", order("a"))["to"].alias("to"))
