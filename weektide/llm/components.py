"""Connected components by contracting a graph on Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weektide.llm.common import written


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``(u, v)``: the smallest node it is connected with.

    In each round every node hooks onto its smallest neighbour, hooks are followed to their
    end once more, and the edges are rewritten between the nodes that remain. A component of
    n nodes keeps at most n / 2, so rounds grow with the logarithm of the longest chain.
    Smallest neighbours combine before the shuffle, and the joins have one unique side, so a
    node with very many edges is split by the adaptive skew handling. Each round is written
    to the shared folder, which also cuts the lineage.
    """
    edges = written(edges.where("u != v").select("u", "v").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        hooks = written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("to")), "hooks")
        further = hooks.select(F.col("node").alias("to"), F.col("to").alias("end"))
        moves = written(hooks.join(further, "to").select("node", F.col("end").alias("to")), "moves")
        if labels is None:
            labels = moves.select("node", F.col("to").alias("root"))
        else:
            on = moves.select(F.col("node").alias("root"), "to")
            labels = labels.join(on, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        labels = written(labels, "labels")
        u_moves = moves.select(F.col("node").alias("u"), F.col("to").alias("a"))
        v_moves = moves.select(F.col("node").alias("v"), F.col("to").alias("b"))
        moved = written(edges.join(u_moves, "u").select("a", "v"), "half-moved").join(v_moves, "v")
        edges = written(moved.where("a != b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return labels
