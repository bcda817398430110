"""Summaries of runs, levels of detail, names and predictions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Screen sizes and polygon targets of the levels of detail.
LOD_LEVELS = ((0, 1.0, 1000), (1, 0.25, 64), (2, 0.05, 12))


def lod_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LOD_LEVELS, "level int, screen_size double, polygon_target int")


def lod_of(screen: Column) -> dict[str, Column]:
    """The level of detail for a share of the screen: the finest whose screen_size it reaches, else the coarsest; and its numbers."""
    pick = lambda at: reduce(lambda out, row: F.when(screen >= row[1], row[at]).otherwise(out), reversed(LOD_LEVELS[:-1]), F.lit(LOD_LEVELS[-1][at]))
    return {"level": pick(0), "screen_size": pick(1), "polygon_target": pick(2)}


def lod_totals(parts: DataFrame, is_fastener: Column) -> DataFrame:
    """parts (original_faces, proxy_faces): how many are substituted and the share of their polygons that saves."""
    f = is_fastener.cast("long")
    out = parts.agg(F.count("*").alias("n_parts"), F.sum(f).alias("n_substituted"), F.sum(F.when(is_fastener, F.col("original_faces")).otherwise(0)).alias("original"), F.sum(F.when(is_fastener, F.col("proxy_faces")).otherwise(0)).alias("proxy"))
    return out.withColumn("reduction", F.when(F.col("original") > 0, 1.0 - F.col("proxy") / F.col("original")).otherwise(0.0))


def measured_dims(**columns: Column) -> Column:
    """The measured dimensions as a map, rounded to three places, without the missing ones."""
    pairs = F.create_map(*[x for k, c in columns.items() for x in (F.lit(k), F.round(c, 3))])
    return F.map_filter(pairs, lambda k, v: v.isNotNull())


def dimension(dims: Column, *keys: str, default: float) -> Column:
    """The first of the keys that the map has."""
    return F.coalesce(*[F.try_element_at(dims, F.lit(k)) for k in keys], F.lit(default))


def binary_class(cls: Column) -> Column:
    return F.when(cls == "non_fastener", "non_fastener").otherwise("fastener")


def run_summary(runs: DataFrame) -> DataFrame:
    """runs (file, seconds, n_parts, n_fasteners, match_rate): totals, median and largest time, mean match rate."""
    return runs.agg(F.count("*").alias("files"), F.sum("n_parts").alias("parts"), F.sum("n_fasteners").alias("fasteners"), F.median("seconds").alias("median_s"), F.max("seconds").alias("max_s"), F.avg("match_rate").alias("mean_match_rate"))


def extremes(runs: DataFrame, k: int = 3) -> DataFrame:
    """The k files of the lowest match rate and the k slowest: kind, rank, file, value."""
    low = runs.orderBy("match_rate", "file").limit(k).select(F.lit("lowest_match_rate").alias("kind"), "file", F.col("match_rate").alias("value"), F.col("match_rate").alias("o"))
    slow = runs.orderBy(F.col("seconds").desc(), "file").limit(k).select(F.lit("slowest").alias("kind"), "file", F.col("seconds").alias("value"), (-F.col("seconds")).alias("o"))
    both = low.union(slow)
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("o", "file"))).drop("o")


def name_coverage(parts: DataFrame, name: str, informative: Column, labelled: Column) -> DataFrame:
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    c = F.col(name)
    return parts.agg(F.count("*").alias("n"), n(c.isNotNull() & (c != "")).alias("named"), n(informative).alias("informative"), n(labelled).alias("labelled"), F.count_distinct(c).alias("distinct_names"))


def classifier_report(df: DataFrame, y: str, pred: str, confidence: str) -> DataFrame:
    """Per predicted class: count, share right (rounded to four places), mean confidence."""
    return df.groupBy(F.col(pred).alias("cls")).agg(F.count("*").alias("n"), F.round(F.avg((F.col(y) == F.col(pred)).cast("double")), 4).alias("precision"), F.round(F.avg(confidence), 4).alias("mean_confidence"))


def meshes_by_name(parts: DataFrame, meshes: DataFrame) -> DataFrame:
    return parts.join(meshes, "name", "left")


def meshes_by_position(parts: DataFrame, meshes: DataFrame, manifest: str = "manifest_id") -> DataFrame:
    """The i-th part of a document with its i-th mesh."""
    at = lambda df: df.withColumn("_i", F.row_number().over(Window.partitionBy(manifest).orderBy("ord")))
    return at(parts).join(at(meshes).drop("ord"), [manifest, "_i"], "left").drop("_i")


def box_contact(a: dict[str, Column], b: dict[str, Column], margin: float = 1.0) -> Column:
    """Boxes (keys lo_x .. hi_z) that overlap when both are grown by the margin."""
    out = None
    for k in "xyz":
        one = (a[f"hi_{k}"] + margin >= b[f"lo_{k}"] - margin) & (b[f"hi_{k}"] + margin >= a[f"lo_{k}"] - margin)
        out = one if out is None else out & one
    return out
