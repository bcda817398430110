"""Exact top-k search by exhaustive term-at-a-time accumulation.

Candidates are laid out in blocks of postings: for every term the rows that
have it and their weights. A block of sparse query rows walks its terms and
scatters weight * posting into a dense score array, takes each query's k best
of the block, and the best of all blocks are merged. Every pair of a query and
a candidate is scored once; nothing is pruned.

A task meets one block of queries with one block of candidates and walks the
candidates in slices, so its score array stays small while a candidate is sent
only once for each ``queries`` queries.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from partloom.llm.runtime import materialise


@dataclass(frozen=True)
class TopK:
    """k best per query; rows of a query block and of a candidate block; slice: candidates scored at a time."""

    k: int = 5
    queries: int = 8192
    candidates: int = 8192
    slice: int = 512


def _dense(lists, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _largest(x: np.ndarray) -> float:
    return float(np.abs(x.astype(np.float64)).max(initial=0))


def accumulate(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Scores (queries, rows) of integer weights, a term at a time: in 32 or 64 bits where no sum can leave them, else in Python's integers."""
    most = _largest(queries) * _largest(rows) * max(1, queries.shape[1])
    kind = np.int32 if most < 2**31 else np.int64 if most < 2**62 else object
    scores = np.zeros((len(rows), len(queries)), dtype=kind)
    for term in range(queries.shape[1]):
        posting = np.flatnonzero(rows[:, term])
        asking = np.flatnonzero(queries[:, term])
        if not len(posting) or not len(asking):
            continue
        weights, wanted = rows[posting, term].astype(kind), queries[asking, term].astype(kind)
        if len(posting) == len(rows) and len(asking) == len(queries):
            scores += weights[:, None] * wanted
        elif len(asking) == len(queries):
            scores[posting] += weights[:, None] * wanted
        else:
            scores[np.ix_(posting, asking)] += weights[:, None] * wanted
    return scores.T


LEAST, MOST = -(1 << 63), (1 << 63) - 1


def _best(asked: np.ndarray, scores: np.ndarray, ids: np.ndarray, k: int):
    """(query, row, score) of each query's k best rows but its own; of equal scores the rows that come first."""
    if scores.dtype == object:
        for q, line in enumerate(scores):
            others = [j for j in range(len(ids)) if ids[j] != asked[q]]
            for j in sorted(others, key=lambda j: (-line[j], j))[:k]:
                yield np.array([q]), np.array([j]), np.array([min(max(int(line[j]), LEAST), MOST)])
        return
    n = len(ids)
    own = ids[None, :] == asked[:, None]
    if scores.dtype == np.int32:  # one integer holds the score and, below it, the place from the end
        order = scores.astype(np.int64) * n + (n - 1 - np.arange(n))
        order[own] = LEAST
        top = np.argpartition(order, max(0, n - k), axis=1)[:, max(0, n - k) :]
    else:
        top = np.argsort(np.where(own, LEAST, scores)[:, ::-1], axis=1, kind="stable")[:, ::-1][:, :k]
        top = n - 1 - top
    q = np.repeat(np.arange(len(asked)), top.shape[1])
    j = top.ravel()
    ok = ~own[q, j]
    yield q[ok], j[ok], scores[q[ok], j[ok]].astype(np.int64)


def _search(p: TopK):
    def run(key, queries, rows):
        import pandas as pd

        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        if not len(queries) or not len(rows):
            return empty
        rows = rows.sort_values("vec_id", kind="stable")
        width = max(queries["w"].map(len).max(), rows["w"].map(len).max())
        asked, ids, held = queries["vec_id"].to_numpy(), rows["vec_id"].to_numpy(), _dense(queries["w"].tolist(), width)
        found = []
        for lo in range(0, len(rows), p.slice):
            part = slice(lo, lo + p.slice)
            scores = accumulate(held, _dense(rows["w"].iloc[part].tolist(), width))
            for q, j, score in _best(asked, scores, ids[part], p.k):
                found.append(pd.DataFrame({"query_id": asked[q], "vec_id": ids[part][j], "score": score}))
            if len(found) > 16:
                found = [_kept(found, p.k)]
        return _kept(found, p.k) if found else empty

    return run


def _kept(found: list, k: int):
    import pandas as pd

    every = pd.concat(found).sort_values(["query_id", "score", "vec_id"], ascending=[True, False, True], kind="stable")
    return every[every.groupby("query_id").cumcount() < k]


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and w = floor(scale * x) of each component; vectors that are null or hold a null, NaN or infinity go.

    A component beyond the range of a long counts as the end of that range.
    """
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    kept = vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & fine)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v.cast("double"))).alias("w"))


def top_k(vectors: DataFrame, is_query, params: TopK = TopK()) -> DataFrame:
    """vectors (vec_id long, w array<long>) -> query_id, rank, vec_id, score.

    ``is_query`` is a Column that marks the query rows. Candidates are all rows
    with another vec_id; a missing component counts as 0. Rows that repeat a
    vec_id stay candidates one by one, and of query rows that repeat one the
    least vector is the query. Ties go to the smaller vec_id. Scores are exact;
    one beyond the range of a long is given as the end of that range. Queries
    without candidates, and an empty table, give no rows. Other columns are
    ignored.
    """
    p = params
    stored = materialise(vectors.select("vec_id", "w", F.monotonically_increasing_id().alias("place")), "vectors")  # written once, so places stay
    asked = stored.where(is_query).groupBy("vec_id").agg(F.min("w").alias("w"), F.min("place").alias("place"))
    n, m = stored.count(), asked.count()
    blocks, shares = max(1, -(-n // p.candidates)), max(1, -(-m // p.queries))
    spread = lambda df, mine, n, other, others: df.withColumn(mine, F.pmod(F.xxhash64("place"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
    left = spread(asked, "q", shares, "c", blocks)
    right = spread(stored, "c", blocks, "q", shares)
    found = left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInPandas(_search(p), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")
