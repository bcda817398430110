"""Order-dependent greedy steps as rounds of joins.

In a round all choices are made at once, or all that no earlier row can still
change, and rounds go on until nothing is open. Rows of one shape are a class,
so copies of a part don't multiply the candidates.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.operators.prefix import ranked
from partloom.tables import merged, written


def _in_order(rows: DataFrame, side: str) -> DataFrame:
    """rows (cls, part_id, ord) -> cls, ``side``_id and ``side``, the place in the order of (ord, part_id)."""
    placed = ranked(rows.select("cls", "part_id", "ord"), [], ["ord", "part_id"])
    return written(placed.select("cls", F.col("part_id").alias(f"{side}_id"), F.col("rank").alias(side)), side)


def _wishes(batches):
    """Rows of a class: its parts in order (kind 0), then its candidates from best to worst (kind 1) -> a candidate for each part.

    A part takes the next candidate that no earlier part of another class holds. What it passes over, no later part
    of its class can have either, so one walk serves them all. Of a class only the places of its parts are kept.
    """
    import pandas as pd

    now, places, i = None, [], 0
    for batch in batches:
        out = []
        for cls, kind, worse, place, by, held in batch.itertuples(index=False, name=None):
            if cls != now:
                now, places, i = cls, [], 0
            if kind == 0:
                places.append(place)
            elif i < len(places) and (by < 0 or by == cls or held > places[i]):
                out.append((cls, places[i], place, -worse))
                i += 1
        yield pd.DataFrame(out, columns=["cls", "n", "o", "confidence"]).astype({"cls": "int64", "n": "int64", "o": "int64", "confidence": "float64"})


def greedy_by_class(new: DataFrame, old: DataFrame, pairs: DataFrame) -> DataFrame:
    """new, old (cls, part_id, ord), pairs (new_class, old_class, confidence) -> new_id, old_id, confidence.

    In order of (ord, part_id) each new part takes, of the old parts still free, one of the greatest confidence,
    the first in order on ties.

    That is the stable matching in which an old part prefers earlier new ones, so it is found by deferred
    acceptance: every class of new parts names old ones for its parts, an old part stays with the earliest that
    named it, and classes that lost one name others, until none has. Parts of one class share their candidates; a
    class is walked in one task, which keeps a number for each of its parts.
    """
    news, olds = _in_order(new, "n"), _in_order(old, "o")
    classes = news.groupBy("cls").agg(F.min("n").alias("c"))
    parts = written(merged(news).join(merged(classes), "cls").select("c", "n"), "parts")
    named = merged(pairs).join(merged(classes), F.col("new_class") == F.col("cls")).drop("cls")
    wanted = written(merged(named).join(merged(olds), F.col("old_class") == olds.cls).select("c", "o", (-F.col("confidence")).alias("worse")), "wanted")
    spark = new.sparkSession
    kept = written(spark.createDataFrame([], "cls long, n long, o long, confidence double"), "kept")
    active = written(parts.select("c").distinct(), "active")
    nobody, none = F.lit(-1).cast("long"), F.lit(0.0)
    while not active.isEmpty():
        holders = kept.select("o", F.col("cls").alias("by"), F.col("n").alias("held"))
        asked = merged(merged(wanted).join(merged(active), "c", "left_semi")).join(merged(holders), "o", "left").select("c", F.lit(1).alias("kind"), "worse", F.col("o").alias("place"), F.coalesce("by", nobody).alias("by"), F.coalesce("held", nobody).alias("held"))
        own = merged(parts).join(merged(active), "c", "left_semi").select("c", F.lit(0).alias("kind"), none.alias("worse"), F.col("n").alias("place"), nobody.alias("by"), nobody.alias("held"))
        wishes = own.union(asked).repartition("c").sortWithinPartitions("c", "kind", "worse", "place").mapInPandas(_wishes, kept.schema)
        quiet = merged(kept).join(merged(active.withColumnRenamed("c", "cls")), "cls", "left_anti")
        made = written(quiet.unionByName(wishes), "made")
        first = made.groupBy("o").agg(F.min("n").alias("n"))
        kept = written(merged(made).join(merged(first), ["o", "n"]).select("cls", "n", "o", "confidence"), "kept")
        active = written(merged(made).join(merged(first), ["o", "n"], "left_anti").select(F.col("cls").alias("c")).distinct(), "active")
    out = merged(kept).join(merged(news.select("n", F.col("n_id").alias("new_id"))), "n")
    return merged(out).join(merged(olds.select("o", F.col("o_id").alias("old_id"))), "o").select("new_id", "old_id", "confidence")


def greedy_one_to_one(candidates: DataFrame) -> DataFrame:
    """candidates (new_part_id, new_ord, old_part_id, old_ord, confidence) -> new_id, old_id, confidence: each part its own class."""
    side = lambda k: candidates.select(F.col(f"{k}_part_id").alias("cls"), F.col(f"{k}_part_id").alias("part_id"), F.col(f"{k}_ord").alias("ord")).distinct()
    return greedy_by_class(side("new"), side("old"), candidates.select(F.col("new_part_id").alias("new_class"), F.col("old_part_id").alias("old_class"), "confidence"))


def earliest_seeds(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (node), edges (a, b) with a < b -> (node, seed): in order, a node that no earlier seed has taken is a seed.

    A round makes seeds of the open nodes without an earlier open neighbour, and takes their neighbours.
    """
    found, nodes, edges = [], written(nodes.select("node"), "nodes"), written(edges.select("a", "b"), "edges")
    every = edges
    while not nodes.isEmpty():
        seeds = written(nodes.join(edges.select(F.col("b").alias("node")).distinct(), "node", "left_anti"), "seeds")
        found.append(seeds)
        taken = edges.join(seeds.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        settled = written(seeds.union(taken), "settled")
        nodes = written(nodes.join(settled, "node", "left_anti"), "nodes")
        for end in "ab":
            edges = edges.join(settled.withColumnRenamed("node", end), end, "left_anti")
        edges = written(edges.select("a", "b"), "edges")
    if not found:
        return nodes.select("node", F.col("node").alias("seed"))
    seeds = reduce(DataFrame.union, found)
    owners = every.join(seeds.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("seed"))
    return seeds.select("node", F.col("node").alias("seed")).union(owners.select("node", "seed"))


def repetition_groups(parts: DataFrame, tol: float = 0.02) -> DataFrame:
    """parts (part_id, ord, diameter, length, volume) -> part_id, seed_id, repetition for groups of two or more.

    In order, each part not yet grouped seeds a group of the later free parts within ``tol`` of the seed's own
    diameter, length and (if both have one) volume. Parts of equal measures share the fate of the first of them, so
    shapes are compared, not parts: they meet in neighbouring bands of log diameter and log length.
    """
    width = -math.log(1 - tol) if tol < 1 else 1.0
    band = lambda c: F.floor(F.log(F.greatest(F.col(c), F.lit(1e-9))) / width).cast("long")
    solid = parts.where("diameter > 0 and length > 0").withColumn("volume", F.when(F.col("volume") > 0, F.col("volume")))
    measures = ["diameter", "length", "volume"]
    shapes = written(solid.groupBy(*measures).agg(F.min("ord").alias("first"), F.count("*").alias("n")), "shapes")
    p = shapes.withColumn("bd", band("diameter")).withColumn("bl", band("length"))
    seed = p.select(*[F.col(c).alias(f"s_{c}") for c in (*measures, "first")], "bd", "bl")
    for c in ("bd", "bl"):
        seed = seed.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    near = lambda c: F.abs(F.col(f"s_{c}") - F.col(c)) / F.col(f"s_{c}") <= tol
    close = near("diameter") & near("length") & F.coalesce(near("volume"), F.lit(True))
    pairs = seed.join(p, ["bd", "bl"]).where("s_first < first").where(close).select(F.col("s_first").alias("a"), F.col("first").alias("b"))
    owner = written(earliest_seeds(shapes.select(F.col("first").alias("node")), pairs), "owners")
    sized = shapes.join(owner, F.col("first") == F.col("node"))
    groups = sized.groupBy("seed").agg(F.sum("n").alias("repetition")).where("repetition > 1")
    named = solid.join(sized.select(*[F.col(c).alias(f"_{c}") for c in measures], "seed"), reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in measures]))
    seeds = parts.select(F.col("ord").alias("seed"), F.col("part_id").alias("seed_id"))
    return named.select("part_id", "seed").join(groups, "seed").join(seeds, "seed").select("part_id", "seed_id", "repetition")
