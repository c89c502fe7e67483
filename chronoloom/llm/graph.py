"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.session import written


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of the undirected edges (a, b): the smallest node that can be reached.

    Rounds of contraction: each node moves to its neighbour of the smallest hash, if that is smaller than its own (the hash
    changes with the round), and from there as that neighbour moves; edges are renamed accordingly, loops and repeats go.
    At most half of the nodes are expected to stay, whatever the graph and its numbering, so the number of rounds follows
    the logarithm of the largest component and edges shrink from round to round. Minima are aggregated before they are
    shuffled; a node with very many edges is split by the adaptive join.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    live = written(both.where("a != b").distinct(), "edges")
    labels = live.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    turn = 0
    while not live.isEmpty():
        near = live.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", F.lit(turn)).alias("h"), "b")).alias("near"))
        own = F.struct(F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("b"))
        moves = written(near.select("a", F.when(F.col("near") < own, F.col("near.b")).otherwise(F.col("a")).alias("to")), "moves")
        onward = moves.select(F.col("a").alias("to"), F.col("to").alias("at"))
        moves = written(moves.join(onward, "to").select(F.col("a").alias("component"), "at"), "moves")
        labels = labels.join(moves, "component", "left").select("node", F.coalesce("at", "component").alias("component"))
        labels = written(labels, "labels")
        one, two = (moves.select(F.col("component").alias(c), F.col("at").alias(f"{c}_at")) for c in "ab")
        live = live.join(one, "a").join(two, "b").where("a_at != b_at").select(F.col("a_at").alias("a"), F.col("b_at").alias("b"))
        live = written(live.distinct(), "edges")
        turn += 1
    smallest = labels.groupBy("component").agg(F.min("node").alias("least"))
    return labels.join(smallest, "component").select("node", F.col("least").alias("component"))
