"""A training corpus from ``documents``: quality, exact copies, near copies, mixture, sequences.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows as Parquet in the shared folder and hands the reread table to
the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from partloom.llm import exact_dedup, mixing, near_dedup, packing, quality_fm
from partloom.llm.queries import tokenizer_path
from partloom.llm.runtime import materialise, table
from partloom.tables import kept, scope


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine doesn't reject."""
    model = quality_fm.fit_on(docs, table(spark, sf_dir, "labels"))
    return quality_fm.keep_good(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row, that with the largest doc_id; a null doc_id counts as the smallest."""
    return _only(docs, lambda keyed: exact_dedup.exact_dedup(keyed, exact_dedup.older_half(keyed)), F.asc_nulls_first("doc_id"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, five words to a shingle: that with the smallest doc_id, a null counting as the largest."""
    return _only(docs, near_dedup.near_duplicates, F.asc_nulls_last("doc_id"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents repeated whole and in part."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, packing.Packing(tokenizer_path()))


def _only(docs: DataFrame, dedup: Callable[[DataFrame], DataFrame], order: Column) -> DataFrame:
    """The rows of docs that dedup, given (doc_id, text), marks as kept, each row a document of its own.

    Where doc_id repeats or is null, rows get keys in ``order``, written once, that stand in for it.
    """
    if docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").isEmpty():
        stays = dedup(docs).where("kept").select(F.col("doc_id").alias("id")).alias("stays")
        return docs.alias("docs").join(stays, F.col("docs.doc_id") == F.col("stays.id"), "left_semi")
    rows = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.monotonically_increasing_id().alias("tie"))
    keyed = materialise(rows.orderBy(order, "tie").select("row", F.monotonically_increasing_id().alias("key")), "keyed")
    stays = dedup(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).where("kept")
    return keyed.join(stays.select(F.col("doc_id").alias("key")), "key", "left_semi").select("row.*")


STAGES = [("quality", quality), ("exact dedup", exact), ("near dedup", near), ("mixing", mix), ("packing", pack)]

#: SQL can't express the classifier or the tokenizer; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn. What a stage writes besides its rows is deleted when these are written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scope(spark) as outer:
            docs = kept(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}", outer)
    return STAGES[-1][1](spark, docs, sf_dir)
