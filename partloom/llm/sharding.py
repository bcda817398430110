"""Sharding by minimax contiguous partition of atomic groups.

Documents with equal texts form a group that is never split. Groups stand in
the order of their texts' SHA-256 digests, and the shards are contiguous runs
of groups whose largest size is as small as possible: a binary search over the
capacity, each tried by cutting greedily.

The driver never holds the groups. It starts from sums over blocks of digests
that share leading hex digits, a number bounded by ``fan_out``, and splits only
the blocks in which a cut can fall, until those are single groups.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.ranks import gapless_rank
from partloom.llm.runtime import materialise


@dataclass(frozen=True)
class Sharding:
    """digits: hex digits of the first blocks (16**digits of them); step: digits by which a block is split."""

    shards: int = 8
    digits: int = 3
    step: int = 2


@dataclass
class Blocks:
    """Blocks in order: their leading digits, sums, largest groups, and whether they are one group."""

    lead: list[str]
    total: np.ndarray
    largest: np.ndarray
    single: np.ndarray


def _greedy(b: Blocks, ends: np.ndarray, capacity: int, shards: int, fluid: bool) -> list[int] | None:
    """Cut positions (in bytes) of the greedy partition, or None if it needs more shards.

    fluid: a block of several groups may be cut anywhere (no worse than the truth); else it is atomic.
    """
    cuts, at, whole = [], 0, int(ends[-1]) if len(ends) else 0
    for _ in range(shards):
        if at + capacity >= whole:
            return cuts + [whole] * (shards - len(cuts))
        k = int(np.searchsorted(ends, at + capacity, side="right"))
        stop = int(ends[k - 1]) if k else 0
        if fluid and not b.single[k]:
            stop = at + capacity
        if stop <= at:
            return None
        cuts.append(stop)
        at = stop
    return None


def _least(b: Blocks, shards: int, fluid: bool) -> tuple[int, list[int]]:
    ends = np.cumsum(b.total)
    whole = int(ends[-1])
    low, high = max(-(-whole // shards), int(b.largest.max())), whole
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _greedy(b, ends, mid, shards, fluid) is not None else (mid + 1, high)
    return low, _greedy(b, ends, low, shards, fluid)


def _blocks(groups: DataFrame, digits: int, within: list[str] | None) -> list:
    lead = F.substring("digest", 1, digits)
    part = groups if within is None else groups.where(F.substring("digest", 1, len(within[0])).isin(within))
    return part.groupBy(lead.alias("lead")).agg(F.sum("bytes"), F.max("bytes"), F.count("*")).orderBy("lead").collect()


def minimax_cuts(groups: DataFrame, params: Sharding = Sharding()) -> tuple[list[str], int]:
    """groups (digest hex string, bytes long) -> the first digest of each shard but the first (prefixes), and the capacity."""
    p = params
    rows = _blocks(groups, p.digits, None)
    if not rows:
        return [], 0
    b = Blocks([r[0] for r in rows], np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), np.array([r[3] == 1 for r in rows]))
    while True:
        ends = np.cumsum(b.total)
        best, low_cuts = _least(b, p.shards, True)
        high = best
        try_atomic = Blocks(b.lead, b.total, b.total, b.single)
        high, _ = _least(try_atomic, p.shards, False)
        # A cut for any capacity between the two bounds falls between these positions.
        high_cuts = _greedy(b, ends, high, p.shards, True)
        touched = set()
        for lo, hi in zip(low_cuts[:-1], high_cuts[:-1], strict=True):
            first, last = (int(np.searchsorted(ends, x, side="left")) for x in (min(lo, hi), max(lo, hi)))
            touched |= set(range(max(0, first - 1), min(len(ends), last + 2)))
        for lo in low_cuts[:-1]:
            touched |= {int(np.searchsorted(ends, lo, side="left"))} & set(range(len(ends)))
        split = sorted(i for i in touched if not b.single[i])
        if not split:
            capacity, cuts = _least(Blocks(b.lead, b.total, b.largest, np.ones(len(ends), dtype=bool)), p.shards, False)
            starts = np.concatenate([[0], ends[:-1]])
            firsts = []
            for cut in cuts[:-1]:
                k = int(np.searchsorted(starts, cut, side="left"))
                firsts.append(b.lead[k] if k < len(b.lead) else "~")
            return firsts, capacity
        by_length: dict[int, list[str]] = {}
        for i in split:
            by_length.setdefault(len(b.lead[i]), []).append(b.lead[i])
        finer = {}
        for n, leads in by_length.items():
            for r in _blocks(groups, n + p.step, leads):
                finer.setdefault(r[0][:n], []).append(r)
        out = []
        gone = set(split)
        for i in range(len(b.lead)):
            if i in gone:
                out += [(r[0], r[1], r[2], r[3] == 1) for r in finer[b.lead[i]]]
            else:
                out.append((b.lead[i], int(b.total[i]), int(b.largest[i]), bool(b.single[i])))
        b = Blocks([x[0] for x in out], *(np.array([x[k] for x in out]) for k in (1, 2, 3)))


def shard_documents(docs: DataFrame, params: Sharding = Sharding()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, capacity.

    size: UTF-8 bytes of the text plus 1; a null text counts as empty. law is
    ``bytes``: shard sizes are as equal as uncut groups allow. slot numbers a
    shard's rows from 0 without gaps. One row per input row; repeated rows stay
    together and get slots of their own, and so do rows without a doc_id. Texts
    of any length are measured and hashed whole, and a text larger than a fair
    share has a shard to itself. Other columns are ignored. An empty table gives
    an empty result; shards may be empty if there are fewer groups than shards.
    """
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    slim = materialise(slim, "sized")
    groups = materialise(slim.groupBy("digest").agg(F.sum("size").alias("bytes")), "groups")
    firsts, capacity = minimax_cuts(groups, params)
    begun = F.filter(F.array(*map(F.lit, firsts)).cast("array<string>"), lambda first: F.col("digest") >= first)
    shard = F.size(begun)
    placed = gapless_rank(slim.withColumn("shard", shard.cast("int")), "shard", ["doc_id", "digest"], "slot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.lit(capacity).cast("long").alias("capacity"))
