"""Graphs within groups, as rounds of joins: components by contraction, ring order by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.tables import merged, written


def _jumped(to: DataFrame, label: str) -> DataFrame:
    """to (g, node, up) with up not above node -> up is the end of each node's way."""
    to = written(to, label)
    while True:
        again = to.select("g", F.col("node").alias("up"), F.col("up").alias("far"))
        then = written(to.join(merged(again), ["g", "up"], "left").select("g", "node", F.coalesce("far", "up").alias("up"), (F.col("far") != F.col("up")).alias("moved")), label)
        to = then.select("g", "node", "up")
        if then.where("moved").isEmpty():
            return to


def components(edges: DataFrame) -> DataFrame:
    """edges (g, a, b) -> (g, node, component): the least node that each can reach within its group.

    A round points every node at its least neighbour, follows these pointers to
    their ends, and goes on with the edges between different ends; the number of
    nodes with edges at least halves. Nodes come from edges only, a self loop
    makes a node of its own.
    """
    now = written(edges.select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    labels = written(now.select("g", F.col("a").alias("node")).union(now.select("g", "b")).distinct().withColumn("component", F.col("node")), "labels")
    now = now.where("a < b")
    while not now.isEmpty():
        both = now.select("g", F.col("a").alias("node"), F.col("b").alias("up")).union(now.select("g", "b", "a"))
        least = both.groupBy("g", "node").agg(F.least(F.min("up"), F.col("node")).alias("up"))
        ends = _jumped(least, "ends")
        for c in ("a", "b"):
            now = now.join(merged(ends.select("g", F.col("node").alias(c), F.col("up").alias(f"_{c}"))), ["g", c]).drop(c).withColumnRenamed(f"_{c}", c)
        now = written(now.where("a <> b").select("g", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        moved = ends.select("g", F.col("node").alias("component"), F.col("up").alias("_end"))
        labels = written(labels.join(merged(moved), ["g", "component"], "left").select("g", "node", F.coalesce("_end", "component").alias("component")), "labels")
    return labels


def ring_order(steps: DataFrame) -> DataFrame:
    """steps (g, a, b), at most one out of and one into a node -> (g, ring, pos, node).

    ring is the least node of a ring, pos the number of steps from it, counted
    backwards while ways double and turned at the end. Chains that don't close
    are left out. The rounds are as many as the logarithm of the longest ring.
    """
    now = written(steps.select("g", F.col("a").alias("node"), F.col("b").alias("next"), F.least("a", "b").alias("low"), F.lit(False).alias("open")), "rings")
    while True:
        ahead = now.select("g", F.col("node").alias("next"), F.col("next").alias("far"), F.col("low").alias("far_low"), F.col("open").alias("far_open"))
        then = now.join(merged(ahead), ["g", "next"], "left")
        lower = F.least("low", F.coalesce("far_low", "low"))
        opened = F.col("open") | F.col("far").isNull() | F.coalesce("far_open", F.lit(False))
        then = then.select("g", "node", F.coalesce("far", "next").alias("next"), lower.alias("low"), opened.alias("open"), ((lower < F.col("low")) | (opened != F.col("open"))).alias("moved"))
        then = written(then, "rings")
        now = then.drop("moved")
        if then.where("moved").isEmpty():
            break
    rings = written(now.where("not open").select("g", "node", "low"), "rings")
    # From each node to its ring's least one: the step into that node ends the way.
    left = steps.select("g", F.col("a").alias("node"), F.col("b").alias("next")).join(merged(rings), ["g", "node"])
    left = written(left.select("g", "node", "next", "low", F.lit(1).cast("long").alias("far"), (F.col("next") == F.col("low")).alias("done")), "ways")
    while not left.where("not done").isEmpty():
        ahead = left.select("g", F.col("node").alias("next"), F.col("next").alias("_next"), F.col("far").alias("_far"), F.col("done").alias("_done"))
        step = left.join(merged(ahead), ["g", "next"], "left")
        go = ~F.col("done")
        left = written(step.select("g", "node", F.when(go, F.col("_next")).otherwise(F.col("next")).alias("next"), "low", F.when(go, F.col("far") + F.col("_far")).otherwise(F.col("far")).alias("far"), F.when(go, F.col("_done")).otherwise(True).alias("done")), "ways")
    sizes = left.groupBy("g", "low").agg(F.count("*").alias("n"))
    return left.join(merged(sizes), ["g", "low"]).select("g", F.col("low").alias("ring"), ((F.col("n") - F.col("far")) % F.col("n")).alias("pos"), "node")


def paired_steps(edges: DataFrame) -> DataFrame:
    """edges (g, a, b) directed, several through one node -> steps between edges (g, a, b), each an ``edge`` number.

    Where a node has several edges in and out, the k-th in (by its start) goes on as the k-th out (by its end).
    """
    out = Window.partitionBy("g", "a").orderBy("b")
    into = Window.partitionBy("g", "b").orderBy("a")
    leaving = edges.select("g", F.col("a").alias("at"), F.col("edge").alias("after"), F.row_number().over(out).alias("k"))
    coming = edges.select("g", F.col("b").alias("at"), F.col("edge").alias("before"), F.row_number().over(into).alias("k"))
    return coming.join(merged(leaving), ["g", "at", "k"]).select("g", F.col("before").alias("a"), F.col("after").alias("b"))
