"""Which of five text filters removes what, in every order, by a Walsh-Hadamard audit.

A document's failures are a mask of five bits. Per part and label (all
documents, the good, the toxic) only the 32 signed parity sums
S[w] = sum over documents of (-1)^|mask & w| are aggregated; the transform is
its own inverse up to the factor 32, so the number of documents with each mask
comes back exactly. All 120 orders are then read off 32 cells: a filter removes
what fails it and nothing before it, and over all orders it removes a document
that fails it 120 / (number of failed filters) times.

Texts are read once. A digest, a mask and two label bits per document are
shuffled, and summed up before they meet by digest, so a text held by a third of
all rows is one row for each part and label in each task.
"""

from __future__ import annotations

import hashlib
import itertools

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.runtime import utf8

LETTERS = "ABCDE"
ORDERS = ["".join(p) for p in itertools.permutations(LETTERS)]
UPPER = bytes(range(65, 91))
MARKS = b"#$%&*|"
#: UTF-8 bytes that don't begin a code point.
INNER = bytes(range(0x80, 0xC0))
CELLS = 32


def text_mask(text: bytes) -> int:
    """Bits of the failed conditions A (1), B (2), C (4) and D (8)."""
    words = text.split()
    upper = len(text) - len(text.translate(None, UPPER))
    points = len(text.translate(None, INNER))
    few, repetitive = len(words) < 50, 100 * len(set(words)) < 65 * len(words)
    return few | repetitive << 1 | (100 * upper > 5 * points) << 2 | (len(text.translate(None, MARKS)) < len(text)) << 3


def _masks(batches):
    for batch in batches:
        masks, digests = [], []
        for text in batch.column("text"):
            text = text.as_py() or b""
            masks.append(text_mask(text))
            digests.append(hashlib.sha256(text).digest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(masks, pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"])


def failure_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, good, toxic, mask, n_ok, n_copy): documents by label and the failed filters A to D; n_copy of them fail E too."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), utf8("text").alias("text"))
    # Rows without a doc_id meet no label; a number of their own deals them evenly.
    rows = slim.mapInArrow(_masks, "doc_id long, part string, mask int, digest binary").withColumn("key", F.coalesce("doc_id", F.monotonically_increasing_id()))
    marked = labels.select(F.col("doc_id").cast("long").alias("key"), (F.col("quality") == 1).alias("is_good"), (F.col("toxic") == 1).alias("is_toxic")).where("key is not null")
    told = marked.groupBy("key").agg(F.max("is_good").alias("is_good"), F.max("is_toxic").alias("is_toxic")).withColumn("known", F.lit(True))
    rows = rows.join(told, "key", "left")
    hit = F.col("known") & F.col("doc_id").isNotNull()
    rows = rows.select("key", "doc_id", "part", "mask", "digest", F.coalesce(hit & F.col("is_good"), F.lit(False)).alias("good"), F.coalesce(hit & F.col("is_toxic"), F.lit(False)).alias("toxic"))
    cell = ["digest", "part", "good", "toxic", "mask"]
    rows = rows.groupBy("key", "doc_id", *cell).agg(F.count("*").alias("n"))
    counts = rows.groupBy(*cell).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))).alias("n_unnamed"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("low"))
    first = F.min("low.doc_id").over(Window.partitionBy("digest"))
    n_ok = F.coalesce("n_unnamed", F.lit(0)) + F.when(F.col("low.doc_id") == F.col("first"), F.col("low.n")).otherwise(0)
    return counts.withColumn("first", first).withColumn("n_ok", n_ok).select("part", "good", "toxic", "mask", "n_ok", (F.col("n") - F.col("n_ok")).alias("n_copy"))


def mask_cells(counts: DataFrame) -> DataFrame:
    """failure_counts -> part, every, good, toxic: 32 document counts each, by mask, through parity sums and their inverse."""
    label = F.array_compact(F.array(F.lit("every"), F.when(F.col("good"), F.lit("good")), F.when(F.col("toxic"), F.lit("toxic"))))
    rows = counts.withColumn("label", F.explode(label))
    sums = []
    for w in range(CELLS):
        sign = 1 - 2 * (F.bit_count(F.col("mask").bitwiseAND(F.lit(w & 15))) % 2)
        both = F.col("n_ok") - F.col("n_copy") if w & 16 else F.col("n_ok") + F.col("n_copy")
        sums.append(F.sum(sign * both).alias(f"s{w}"))
    parity = rows.groupBy("part", "label").agg(*sums).select("part", "label", F.array(*[f"s{w}" for w in range(CELLS)]).alias("s"))
    inverse = F.expr("transform(sequence(0, 31), m -> aggregate(sequence(0, 31), 0L, (sum, w) -> sum + s[w] * (1 - 2 * (bit_count(m & w) % 2))) div 32)")
    cells = parity.withColumn("cells", inverse)
    none = F.array_repeat(F.lit(0).cast("long"), CELLS)
    return cells.groupBy("part").agg(*[F.coalesce(F.max(F.when(F.col("label") == k, F.col("cells"))), none).alias(k) for k in ("every", "good", "toxic")])


def _over(cells: str, condition: str, value: str = "{}[m]"):
    return F.expr(f"aggregate(sequence(0, 31), 0L, (sum, m) -> sum + if({condition}, {value.format(cells)}, 0L))")


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs (doc_id, text, source, ...), labels (doc_id, quality, toxic) -> a row per part, order and step.

    part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost, shapley. A null text is empty, a null source the part ''. Every
    row counts as a document, repeated rows too; rows with one text and one
    doc_id don't make each other fail E. A null doc_id is smaller than none and
    has no smaller one, so such a row never fails E nor makes others fail, and
    has no label. Of several labels of one doc_id one that says 1 is enough; a
    null label says nothing. The rows of one text that meet in a task are at
    most four for each part. Other columns are ignored; an empty table gives an
    empty result.
    """
    cells = mask_cells(failure_counts(docs, labels))
    orders = cells.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(5))))
    before = "+".join(f"if(instr(filter_order, '{x}') < step, {1 << i}, 0)" for i, x in enumerate(LETTERS))
    orders = orders.withColumn("bit", F.expr("shiftleft(1, ascii(substr(filter_order, step, 1)) - 65)")).withColumn("gone", F.expr(before))
    removes = "m & bit <> 0 AND m & gone = 0"
    return orders.select(
        "part",
        "filter_order",
        "step",
        _over("every", "m & (bit | gone) = 0").alias("kept"),
        _over("every", removes).alias("removed"),
        _over("every", "m & bit <> 0 AND m & gone <> 0").alias("redundant"),
        F.expr("every[bit]").alias("unique_fails"),
        _over("good", removes).alias("good_lost"),
        _over("toxic", removes).alias("toxic_lost"),
        _over("every", "m & bit <> 0", "{}[m] * (120 div bit_count(m))").alias("shapley"),
    )
