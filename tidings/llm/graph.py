"""Connected components by randomised contraction.

In every round each node moves to the neighbour (or itself) with the smallest hash of that round, and
the edges are drawn again between the places moved to. The expected number of nodes with edges falls
by a constant factor, so the rounds grow with the logarithm of the graph, whatever its shape. A node
with very many neighbours is reduced by partial aggregates and, in the joins, split by adaptive
execution; nothing is gathered in one task or the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidings.llm.tables import checkpointed


def components(edges: DataFrame, write=checkpointed) -> DataFrame:
    """(node, root) for every node of the undirected ``edges`` (a, b): equal roots where linked.

    Loops and repeated edges change nothing; without edges there are no rows.
    ``write`` cuts the lineage of a round's tables.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    open_edges = write(both.filter("a <> b").distinct())
    moves: list[DataFrame] = []
    while not open_edges.isEmpty():
        seed = F.lit(len(moves))
        nearest = open_edges.groupBy("a").agg(F.min(F.struct(F.xxhash64("b", seed).alias("h"), F.col("b").alias("to"))).alias("n"))
        own = F.struct(F.xxhash64("a", seed).alias("h"), F.col("a").alias("to"))
        move = write(nearest.select(F.col("a").alias("node"), F.least("n", own)["to"].alias("root")))
        moves.append(move)
        left, right = move.select(F.col("node").alias("a"), F.col("root").alias("ra")), move.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        drawn = open_edges.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        open_edges = write(drawn.filter("a <> b").distinct())
    if not moves:
        return open_edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = moves.pop()
    while moves:
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        roots = moves.pop().join(later, "root", "left").select("node", F.coalesce("last", "root").alias("root"))
    return write(roots)
