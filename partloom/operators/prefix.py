"""Running sums and ranks within groups of any size: pieces of the order are summed apart, then shifted by the pieces before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.tables import merged, written


def running(rows: DataFrame, groups: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    """Adds for each of ``sums`` what comes before the row in its group by ``order``; 0 for the first. Null is a group of its own.

    The rows are dealt by ranges of (group, order), so no group meets in one task, whatever its size.
    """
    keyed = rows.withColumn("_group", F.struct(F.lit(0), *groups)).withColumn("_place", F.struct(*order))
    for i, c in enumerate(sums.values()):
        keyed = keyed.withColumn(f"_v{i}", c)
    dealt = written(keyed.repartitionByRange("_group", "_place").withColumn("_piece", F.spark_partition_id()), "dealt")
    names = {f"_v{i}": name for i, name in enumerate(sums)}
    pieces = dealt.groupBy("_group", "_piece").agg(*[F.sum(v).alias(f"{v}_all") for v in names])
    earlier = Window.partitionBy("_group").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("_group").alias("_its"), F.col("_piece").alias("_at"), *[F.coalesce(F.sum(f"{v}_all").over(earlier), F.lit(0)).alias(f"{v}_before") for v in names])
    inside = Window.partitionBy("_group", "_piece").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select(*rows.columns, "_group", "_piece", *[F.coalesce(F.sum(v).over(inside), F.lit(0)).alias(v) for v in names])
    # There are as many pieces as groups, if not more; the window has sorted the rows for this join.
    out = out.join(merged(pieces), (F.col("_group") == F.col("_its")) & (F.col("_piece") == F.col("_at")))
    return out.select(*rows.columns, *[(F.col(v) + F.col(f"{v}_before")).alias(name) for v, name in names.items()])


def ranked(rows: DataFrame, groups: list[str], order: list, name: str = "rank") -> DataFrame:
    """Adds ``name``: 0, 1, ... within each group by ``order``."""
    return running(rows, groups, order, {name: F.lit(1).cast("long")})
