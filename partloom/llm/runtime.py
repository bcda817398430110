"""Shared-folder tables, and what Python workers keep between batches."""

from __future__ import annotations

import sys
import types

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import partloom
from partloom.tables import written

# Executors need no installed copy of this package: its functions travel with the plan.
cloudpickle.register_pickle_by_value(partloom)


#: The HOT most frequent keys reach their rows by broadcast; any other has fewer than 1/HOT of all rows.
HOT = 512


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs no rework."""
    return written(df, label)


def keyed_join(rows: DataFrame, per_key: DataFrame, key: list[str], count: str) -> DataFrame:
    """rows joined with per_key, a written table of one row per key, whose column ``count`` says how many of the rows have it.

    The HOT most frequent keys meet their rows by a broadcast of their few rows, the others by a shuffle, in which no
    key has 1/HOT of the rows, and in which rows that have met theirs are dealt evenly. The plan is the same whatever
    the counts.
    """
    hot = materialise(per_key.orderBy(F.col(count).desc(), *key).limit(HOT), "hot")
    got = F.struct(*[c for c in per_key.columns if c not in key])
    met = rows.join(F.broadcast(hot.select(*key, got.alias("_few"))), key, "left")
    even = F.xxhash64(*rows.columns)
    even = F.unhex(F.hex(even)) if dict(rows.dtypes)[key[0]] == "binary" else even
    first = F.when(F.col("_few").isNull(), F.col(key[0])).otherwise(even)
    rest = per_key.select(*[F.col(k).alias(f"_{k}") for k in key], got.alias("_row"))
    on = F.col("_few").isNull() & (first == F.col(f"_{key[0]}"))
    for k in key[1:]:
        on = on & (F.col(k) == F.col(f"_{k}"))
    joined = met.join(rest, on, "left").withColumn("_got", F.coalesce("_few", "_row"))
    return joined.where("_got is not null").select(*rows.columns, "_got.*")


def worker_store(name: str, make, large: bool = False):
    """An object that lives as long as the Python worker, shared by its tasks.

    Of the large ones a worker holds one at a time: a stage that needs another
    lets go of what the stage before it remembered.
    """
    module = sys.modules.setdefault("_partloom_worker", types.ModuleType("_partloom_worker"))
    held = module.__dict__.setdefault("held", {})
    if name not in held:
        if large:
            for other in [k for k, (_, big) in held.items() if big]:
                del held[other]
        held[name] = (make(), large)
    return held[name][0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column: str):
    """A text column as bytes; null stays null."""
    return F.col(column).cast("binary")
