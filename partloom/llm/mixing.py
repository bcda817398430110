"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Sources that would need more than ``epochs`` passes over their words are
clamped there, and what they leave is shared by weight among the others. With
the sources in order of cap/weight the clamped ones are a prefix, so one
running sum over the table of sources replaces the repeated redistribution.

A source's documents are dealt by a seeded hash into strata of about
``stratum`` rows. Every document is taken floor(target / size) times whole;
what remains of a stratum's share is taken in seeded order, whole documents
first and of one document a leading part, so that the words taken come to the
target. Strata keep a source with a third of all rows out of a single task.
``mixed_documents`` gives out whole documents only: the one that is taken in
part stays or goes by a seeded draw with that part as its chance.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.runtime import materialise

WORD = "[^\\x20\\x09-\\x0D]+"


@dataclass(frozen=True)
class Mixing:
    """weights: repeated over the sources in code-point order. epochs: most passes over a source."""

    weights: tuple[int, ...] = (1, 2, 3)
    epochs: int = 3
    seed: str = "mix-1"
    stratum: int = 1024


def words_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _row_key() -> Column:
    """The doc_id as text; rows without one get a number of their own, which holds once it is written."""
    return F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.monotonically_increasing_id().cast("string")))


def _draw(p: Mixing, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(p.seed), key).cast("binary"))


def source_targets(sized: DataFrame, params: Mixing = Mixing()) -> DataFrame:
    """sized (source, size) -> source, source_size, source_rows, target. The table of sources is small: one running sum."""
    p = params
    stats = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    stats = stats.withColumn("w", F.element_at(F.array(*map(F.lit, p.weights)), F.pmod(place, F.lit(len(p.weights))) + 1).cast("long"))
    stats = stats.withColumn("cap", F.col("source_size") * p.epochs)
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "w", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stats = stats.withColumn("left", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
    stats = stats.withColumn("w_left", F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0)))
    stats = stats.withColumn("full", F.col("cap") * F.col("w_left") <= F.col("w") * F.col("left"))
    stats = stats.withColumn("w0", F.max(F.when(~F.col("full"), F.col("w_left"))).over(every)).withColumn("left0", F.max(F.when(~F.col("full"), F.col("left"))).over(every))
    share = (F.col("w") * F.col("left0")).cast("double") / F.col("w0").cast("double")
    return stats.select("source", "source_size", "source_rows", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix_sources(docs: DataFrame, params: Mixing = Mixing()) -> DataFrame:
    """docs (doc_id, text, source, ...) -> doc_id, size, source_size, target, taken.

    One row per input row. Null texts have no words and are taken 0 times; rows
    without a source form a source of their own, the last. Repeated rows and
    rows without a doc_id count one by one, texts of any length whole. A corpus
    without words has targets of 0. Other columns are ignored; an empty table
    gives an empty result.
    """
    p = params
    sized = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words_of(F.col("text")).alias("size"), _row_key().alias("key")), "sized")
    return take(sized, p).select("doc_id", "size", "source_size", "target", "taken")


def take(sized: DataFrame, params: Mixing = Mixing(), ties: tuple[str, ...] = ()) -> DataFrame:
    """sized (doc_id, source, size, key, ...), a written table, with source_size, target and taken added. ties: more columns that put rows in order."""
    p = params
    targets = source_targets(sized, p)
    renamed = targets.withColumnRenamed("source", "its_source")
    rows = sized.join(renamed, F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    strata = F.ceil(F.col("source_rows") / p.stratum)
    rows = rows.withColumn("draw", _draw(p, F.col("key")))
    rows = rows.withColumn("stratum", F.pmod(F.conv(F.substring("draw", 1, 8), 16, 10).cast("long"), strata))
    whole = Window.partitionBy("source", "stratum")
    running = whole.orderBy("draw", "doc_id", "size", *ties).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("words", F.sum("size").over(whole)).withColumn("start", F.sum("size").over(running) - F.col("size"))
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    budget = F.when(F.col("source_size") > 0, F.floor(F.col("target") * F.col("words") / F.col("source_size") + 0.5)).otherwise(0).cast("long")
    extra = F.least(F.greatest(budget - passes * F.col("words") - F.col("start"), F.lit(0).cast("long")), F.col("size"))
    extra = F.when(passes < p.epochs, extra).otherwise(0)
    return rows.withColumn("taken", passes * F.col("size") + extra)


def mixed_documents(docs: DataFrame, params: Mixing = Mixing()) -> DataFrame:
    """docs repeated as the mix takes them: whole rows, with their own columns and texts.

    A row comes taken // size times, and of a stratum's row that is taken in
    part one more copy stays with the chance (taken % size) / size, drawn by the
    seed. Documents taken 0 times go, so rows without words do. Rows that agree
    in every column share their copies.
    """
    names = ["doc_id", "source", "size", "text_hash", "row_hash"]
    others = [c for c in docs.columns if c not in ("doc_id", "source", "text")]
    nulls = F.concat_ws("", *[F.col(c).isNull().cast("string") for c in ("text", *others)])
    of_row = {"doc_id": F.col("doc_id"), "source": F.col("source"), "size": words_of(F.col("text")), "text_hash": F.xxhash64("text"), "row_hash": F.xxhash64(nulls, *others)}
    sized = materialise(docs.select(*[c.alias(k) for k, c in of_row.items()], _row_key().alias("key")), "sized")
    counts = take(sized, params, ("text_hash", "row_hash")).where("taken > 0")
    chance = F.pmod(F.xxhash64(F.lit(params.seed), "key", "text_hash", "row_hash"), F.lit(1 << 30)) / float(1 << 30)
    part = F.when(chance < (F.col("taken") % F.col("size")) / F.col("size"), 1).otherwise(0)
    counts = counts.withColumn("copies", F.floor(F.col("taken") / F.col("size")) + part).groupBy(*names).agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    counts = materialise(counts.where("copies > 0"), "taken")
    rows = docs.select(F.struct(*docs.columns).alias("row"), *[c.alias(f"row_{k}") for k, c in of_row.items()])
    if not counts.where("rows > 1").isEmpty():  # rows equal throughout: one of them stands for all
        rows = rows.dropDuplicates([f"row_{k}" for k in names])
    same = F.lit(True)
    for k in names:
        same = same & F.col(f"row_{k}").eqNullSafe(F.col(k))
    return rows.join(counts, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy")).select(*[F.col("row")[c].alias(c) for c in docs.columns])
