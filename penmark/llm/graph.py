"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from penmark.session import staged


def components(links: DataFrame) -> DataFrame:
    """``(id, comp)`` for every id in the links ``(a, b)``: the smallest id it can reach.

    Each round hooks an id to its smallest neighbour, follows the hooks a few steps and
    contracts the links; every round is a stored table, so nothing is gathered and a
    lost executor costs one round.
    """
    edges = staged(links.select("a", "b").where("a <> b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b"), F.col("a")))
        hooks = staged(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("p")))
        for _ in range(2):
            above = hooks.select(F.col("a").alias("p"), F.col("p").alias("_up"))
            hooks = hooks.join(above, "p").select("a", F.col("_up").alias("p"))
        hooks = staged(hooks)
        left = hooks.select("a", F.col("p").alias("x"))
        right = hooks.select(F.col("a").alias("b"), F.col("p").alias("y"))
        moved = edges.join(left, "a").join(right, "b").where("x <> y")
        edges = staged(moved.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if labels is None:
            labels = hooks.select(F.col("a").alias("id"), F.col("p").alias("comp"))
        else:
            labels = relabel(labels, hooks.select(F.col("a").alias("id"), F.col("p").alias("comp")))
        labels = staged(labels)
    return labels if labels is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("comp"))


def relabel(labels: DataFrame, moves: DataFrame) -> DataFrame:
    """Follow ``moves`` (id -> comp) from the current ``comp``."""
    moves = moves.select(F.col("id").alias("comp"), F.col("comp").alias("_to"))
    return labels.join(moves, "comp", "left").select("id", F.coalesce("_to", "comp").alias("comp"))
