"""Exact dedup against a minimal perfect hash over historical distinct digests.

Historical texts become SHA-256 digests with a winner locator (the largest
doc_id) each. Digests are dealt by their leading bytes into buckets of a few
thousand; a bucket is one row: the displacements of a minimal perfect hash
(hash, displace and compress) and, slot by slot, the full digest, the winner
and the count. Incoming distinct digests look up their slot in their bucket's
row and count as repeats only if all 32 bytes agree; the others are grouped
among themselves. Copies are summed up before they move, so a text held by a
third of all rows is one row per task, and the few texts with so many copies
are sent to their rows by broadcast (``keyed_join``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.runtime import keyed_join, materialise
from partloom.llm.words import U, mix


@dataclass(frozen=True)
class ExactDedup:
    """bucket: mean digests of a bucket, historical and incoming together. load: mean digests of a displacement group."""

    bucket: int = 4096
    load: int = 4


def _parts(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), dtype="<u8").reshape(-1, 4)


def _slot_of(parts: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    return (mix(parts[:, 2] ^ mix(parts[:, 3] + shift.astype(U))) % U(n)).astype(np.int64)


def build(digests: list[bytes], load: int) -> np.ndarray:
    """Displacements that send the n distinct digests to n distinct slots."""
    parts, n = _parts(digests), len(digests)
    groups = (parts[:, 1] % U(-(-n // load))).astype(np.int64)
    sizes = np.bincount(groups, minlength=-(-n // load))
    order = np.argsort(groups, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    taken = np.zeros(n, dtype=bool)
    shifts = np.zeros(len(sizes), dtype=np.uint32)
    tries = np.arange(256)
    for g in np.argsort(-sizes, kind="stable").tolist():
        if not sizes[g]:
            break
        rows = parts[order[starts[g] : starts[g + 1]]]
        base = 0
        while True:
            slots = np.stack([_slot_of(rows[i : i + 1].repeat(len(tries), 0), tries + base, n) for i in range(len(rows))], axis=1)
            free = ~taken[slots].any(axis=1)
            for t in np.flatnonzero(free).tolist():
                if len(set(slots[t].tolist())) == len(rows):
                    taken[slots[t]] = True
                    shifts[g] = base + t
                    break
            else:
                base += len(tries)
                continue
            break
    return shifts


def find(digests: list[bytes], shifts: np.ndarray, n: int) -> np.ndarray:
    parts = _parts(digests)
    return _slot_of(parts, shifts[(parts[:, 1] % U(len(shifts))).astype(np.int64)], n)


def _hash_bucket(p: ExactDedup):
    def run(key, pdf):
        shifts = build(list(pdf["digest"]), p.load)
        slots = find(list(pdf["digest"]), shifts, len(pdf))
        placed = pdf.iloc[np.argsort(slots)]
        return pd.DataFrame(
            {
                "bucket": [key[0]],
                "shifts": [shifts.tobytes()],
                "digests": [b"".join(placed["digest"])],
                "winners": [placed["winner"].to_numpy("int64").tobytes()],
                "counts": [placed["count"].to_numpy("int64").tobytes()],
            }
        )

    return run


def _look_up(key, incoming, held):
    """Slots raised by their repeats, then the incoming digests that no slot holds."""
    if not len(held):
        return incoming.assign(member=False)[["digest", "winner", "count", "member"]]
    row = held.iloc[0]
    slots_of = lambda kind, name: np.frombuffer(row[name], dtype=kind).copy()
    shifts, winners, counts = slots_of("uint32", "shifts"), slots_of("int64", "winners"), slots_of("int64", "counts")
    digests = [row["digests"][i : i + 32] for i in range(0, len(row["digests"]), 32)]
    old = pd.DataFrame({"digest": digests, "winner": winners, "count": counts, "member": True})
    if not len(incoming):
        return old
    slots = find(list(incoming["digest"]), shifts, len(digests))
    same = np.array([digests[s] == d for s, d in zip(slots.tolist(), incoming["digest"], strict=True)])
    at = slots[same]
    old.loc[at, "winner"] = np.maximum(winners[at], incoming["winner"].to_numpy()[same])
    old.loc[at, "count"] = counts[at] + incoming["count"].to_numpy()[same]
    return pd.concat([old, incoming[~same].assign(member=False)[["digest", "winner", "count", "member"]]])


def exact_groups(history: DataFrame, incoming: DataFrame, params: ExactDedup = ExactDedup()) -> DataFrame:
    """history, incoming (doc_id long, digest binary) -> digest, winner, count, member (held by history)."""
    summed = [materialise(df.groupBy("digest").agg(F.coalesce(F.max("doc_id"), F.lit(-(1 << 63))).alias("winner"), F.count("*").alias("count")), "digests") for df in (history, incoming)]
    buckets = max(1, -(-sum(df.count() for df in summed) // params.bucket))
    lead = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    old, new = (df.withColumn("bucket", F.pmod(lead, F.lit(buckets))) for df in summed)
    held = old.groupBy("bucket").applyInPandas(_hash_bucket(params), "bucket long, shifts binary, digests binary, winners binary, counts binary")
    return new.groupBy("bucket").cogroup(held.groupBy("bucket")).applyInPandas(_look_up, "digest binary, winner long, count long, member boolean")


def exact_dedup(docs: DataFrame, is_history, params: ExactDedup = ExactDedup()) -> DataFrame:
    """docs (doc_id long, text string, ...) -> doc_id, keep_id, group_size, kept, text_sha256.

    ``is_history`` is a Column over doc_id that tells the historical rows from
    the incoming ones. One row per input row; equal texts form a group, null
    counts as empty, and the largest doc_id of a group stays. Of rows that
    share both text and doc_id all are marked as kept. A null doc_id wins only
    against other nulls; its keep_id is then null. Texts of any length are
    hashed whole. Other columns are ignored; an empty table gives an empty result.
    """
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256))
    slim = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest.alias("digest"), F.coalesce(is_history, F.lit(False)).alias("old")), "digests")
    groups = materialise(exact_groups(slim.where("old"), slim.where("not old"), params).select("digest", "winner", "count"), "groups")
    none = F.lit(-(1 << 63))
    out = keyed_join(slim.select("doc_id", "digest"), groups, ["digest"], "count").withColumn("keep_id", F.when(F.col("winner") != none, F.col("winner")))
    return out.select("doc_id", "keep_id", F.col("count").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def older_half(docs: DataFrame):
    """About half of the rows, those with the smaller doc_ids: the history when a corpus is checked against itself.

    The result is the same whatever the history is; with a third of all rows on one doc_id the share may be larger.
    """
    middle = docs.agg(F.percentile_approx("doc_id", 0.5, 1000).alias("middle")).first()["middle"]
    return F.col("doc_id") <= F.lit(middle or 0)
