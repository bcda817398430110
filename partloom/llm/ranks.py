"""Gapless ranks within groups of any size, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gapless_rank(rows: DataFrame, group: str, order: list[str], name: str, per_bucket: int = 1024, least: int = 64) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... within each value of ``group``.

    A group's rows are dealt by a hash of ``order`` into buckets, ranked there
    by ``order``, and shifted by the sizes of the buckets before. The number of
    buckets follows the size of the largest group. ``rows`` must be a table
    that reads the same each time.
    """
    most = rows.groupBy(group).count().agg(F.max("count")).first()[0] or 0
    buckets = max(least, -(-most // per_bucket))
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    sizes = dealt.groupBy(F.col(group).alias("_group"), F.col("_bucket").alias("_its")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_group").orderBy("_its").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*order)) - 1
    joined = dealt.withColumn("_within", within).join(sizes, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_its")))
    return joined.withColumn(name, F.col("_before") + F.col("_within")).drop("_bucket", "_group", "_its", "_before", "_within")
