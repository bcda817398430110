"""Connected components by alternating large-star and small-star rounds.

Every round is two joins and two aggregations over the edge table. A node with
so many edges that they would fill a task is joined by broadcast of its one row
(``keyed_join``), so neither a hub's edges nor a component ever meet in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.runtime import HOT, keyed_join, materialise

#: Edges of one node that a task takes without any care.
FEW = 64


def _with_least(rows: DataFrame, hot: bool) -> DataFrame:
    """rows (u, v) with m, the least v of each u."""
    low = rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n_rows"))
    if not hot:
        return rows.join(low.drop("n_rows"), "u")
    return keyed_join(rows, materialise(low, "least"), ["u"], "n_rows")


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))


def _large_star(edges: DataFrame, hot: bool) -> DataFrame:
    """Each node's larger neighbours move to the least of the node and its neighbours."""
    return _with_least(_both_ways(edges), hot).where("v > u").select(F.col("v").alias("a"), F.least("u", "m").alias("b"))


def _small_star(edges: DataFrame, hot: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the least of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    moved = _with_least(down, hot)
    return moved.select(F.when(F.col("v") != F.col("m"), F.col("v")).otherwise(F.col("u")).alias("a"), F.col("m").alias("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Number of edges, two sums that change with them, and the most edges of a node."""
    sums = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("x"), F.sum(F.xxhash64("b", "a") % 998_244_353).alias("y"))
    degree = _both_ways(edges).groupBy("u").count().agg(F.max("count").alias("most"))
    return tuple(sums.crossJoin(degree).first())


def connected(edges: DataFrame, label: str = "components") -> DataFrame:
    """edges (a long, b long) -> (id, comp): each node of an edge with the smallest id it can reach.

    Self loops and repeated edges do no harm; nodes without an edge to another node don't appear.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    mark = _mark(now)
    while mark[0]:
        n, most = mark[0], mark[3]
        hot = most > max(FEW, n // HOT)
        # Without a hub, no node has more smaller neighbours after the large star than it had edges before.
        large = _large_star(now, hot)
        then = materialise(_small_star(materialise(large, label) if hot else large, hot), label)
        now, before, mark = then, mark, _mark(then)
        if mark == before:
            break
    members = now.select(F.col("a").alias("id"), F.col("b").alias("comp"))
    return members.union(now.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())
