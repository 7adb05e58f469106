"""Connected components of a graph that is far larger than one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from purseflow.session import staged


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); nodes share a root iff connected.

    Randomised contraction: in every round each node picks, by a fresh pseudo-random order, the
    first node among itself and its neighbours, and edges are rewritten between the picks. The
    graph shrinks geometrically whatever its shape, so the number of rounds is logarithmic. Picks
    are partial aggregates, and rewriting joins staged tables on both sides, so that adaptive
    execution can split a node with very many edges. Every round is written to the shared folder.

    Null ends and self-loops are ignored, repeated edges harmless; no edges give no rows.
    """
    left = staged(
        edges.filter("a <> b")
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        salt = F.lit(len(rounds))
        ends = left.select("a", "b").union(left.select(F.col("b"), F.col("a")))
        order = lambda name: F.xxhash64(F.col(name), salt)
        picked = ends.groupBy("a").agg(
            F.min_by("b", order("b")).alias("best"), F.min(order("b")).alias("rank")
        )
        picks = staged(
            picked.select(
                F.col("a").alias("node"),
                F.when(F.col("rank") < order("a"), F.col("best")).otherwise(F.col("a")).alias("root"),
            ),
            "picks",
        )
        rounds.append(picks)
        first = picks.select(F.col("node").alias("a"), F.col("root").alias("root_a"))
        second = picks.select(F.col("node").alias("b"), F.col("root").alias("root_b"))
        moved = left.join(first, "a").join(second, "b").filter("root_a <> root_b")
        left = staged(
            moved.select(
                F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")
            ).distinct(),
            "edges",
        )
    if not rounds:
        return left.select(F.col("a").alias("node"), F.col("b").alias("root"))
    # From the last and smallest round backwards: a node's root is the root of its pick.
    roots = rounds[-1]
    for picks in reversed(rounds[:-1]):
        later = roots.select(F.col("node").alias("root"), F.col("root").alias("last"))
        roots = staged(
            picks.join(later, "root", "left").select(
                "node", F.coalesce("last", "root").alias("root")
            ),
            "roots",
        )
    return roots
