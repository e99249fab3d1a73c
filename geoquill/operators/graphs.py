"""Connected components of a graph given as pairs, in rounds whose number grows with the logarithm of the longest path."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoquill.sources.tables import kept, steps, write_table


def _least_neighbour(edges: DataFrame) -> DataFrame:
    """u, m: the least of u and its neighbours v, of edges (u, v). Summed up in each task first, so a hub costs a row a task."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's least neighbour in its place. edges: (u, v), u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return both.join(_least_neighbour(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def small_star(edges: DataFrame) -> DataFrame:
    """A node's smaller neighbours, and the node, are tied to the least of them."""
    least = _least_neighbour(edges)
    moved = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def least_labels(pairs: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """name, comp: for every name of the pairs (a, b) the least name that pairs lead to. rounds: gets the number of rounds.

    Large and small stars in turn, until no edge moves: then each component is a star around its least name. A round is a written table, and tables of past rounds are dropped. Loops, repeated pairs and
    nulls are left out.
    """
    with steps(pairs.sparkSession) as made:
        edges = pairs.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
        edges, before, turn = write_table(edges, "edges"), None, 0
        while True:
            state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38, 0)"))).first()
            if state == before:
                break
            before, turn = state, turn + 1
            edges = write_table(small_star(large_star(edges)), "edges")
        if rounds is not None:
            rounds.append(turn)
        star = edges.select(F.col("u").alias("name"), F.col("v").alias("comp"))
        return kept(made, star.union(star.select(F.col("comp").alias("name"), "comp").distinct()), "components")
