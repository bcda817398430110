"""SimHash near-duplicate groups by bit-sliced comparison of fingerprints.

A fingerprint has 64 bits, one of which is set if it is set in over half the
hashes of a text's word shingles. Fingerprints within ``radius`` bits are
linked. Two that differ in at most 3 of 64 bits agree on at least two of five
blocks of bits, so they meet in one of ten tables keyed by two blocks (25 or 26
bits); a table's bucket is compared as a whole.

Comparison is bit-sliced: fingerprints are stored as 64 bit planes, one lane a
fingerprint and 64 lanes a word. For a query every plane gives the lanes that
differ in that bit, and carry-save counters of bitwise operations (two planes of
count, one that remembers an overflow) add up the distances of 64 lanes at once.
A word of lanes is abandoned as soon as all of them exceed the radius.

Only distinct fingerprints are compared. A bucket of more than ``block``
fingerprints is dealt into blocks whose pairs are tasks of their own, and a task
emits spanning links, not pairs, so that no bucket meets in one task or grows
into its pairs. The number of block pairs is the square of (bucket / block).
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.components import connected
from partloom.llm.near_dedup import _block_pairs, _groups
from partloom.llm.runtime import keyed_join, materialise, utf8

U = np.uint64
FULL = U(0xFFFFFFFFFFFFFFFF)
#: Shingles whose hashes are held at a time.
STEP = 1 << 15


@dataclass(frozen=True)
class SimHash:
    """shingle: words per shingle, repeats included. block: fingerprints of a bucket that one task compares with as many others.

    pairs: (query, word of 64 lanes) pairs that are compared in one vectorised step.
    """

    shingle: int = 3
    block: int = 16384
    pairs: int = 1 << 15

    #: At most 3: the counters hold two bits, and five blocks leave two without a difference.
    radius = 3
    seed = 42
    #: Bits of the five blocks.
    cuts = ((0, 13), (13, 26), (26, 39), (39, 52), (52, 64))


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit set. Bytes of eight lanes are summed in words, 255 hashes at a time."""
    bits = np.unpackbits(h.view(np.uint8), bitorder="little").view(U).reshape(-1, 8)
    total = np.zeros(64, dtype=np.int64)
    for i in range(0, len(bits), 255):
        total += bits[i : i + 255].sum(axis=0, dtype=U).view(np.uint8)
    return total


def fingerprint(text: bytes, p: SimHash = SimHash()) -> int:
    """The 64 bits of a text; 0 without words."""
    words = text.lower().split()
    if not words:
        return 0
    k = p.shingle
    n = max(1, len(words) - k + 1)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False)) if len(words) >= k else iter([b" ".join(words)])
    hashes, total, left = map(xxhash.xxh64_intdigest, shingles, repeat(p.seed)), np.zeros(64, dtype=np.int64), n
    while left:
        step = min(left, STEP)
        total += _bit_counts(np.fromiter(hashes, dtype=U, count=step))
        left -= step
    return int((U(1) << np.flatnonzero(2 * total > n).astype(U)).sum(dtype=U))


def _printer(p: SimHash):
    def run(batches):
        for batch in batches:
            prints = np.array([fingerprint(x.as_py() or b"", p) for x in batch.column("text")], dtype=U)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "print"])

    return run


def _planes(prints: np.ndarray, word: np.ndarray, lane: np.ndarray, n_words: int) -> np.ndarray:
    """planes[j, w]: bit j of the fingerprints in the lanes of word w."""
    out = np.zeros((64, n_words), dtype=U)
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    for j in range(64):
        out[j, word[starts]] = np.bitwise_or.reduceat(((prints >> U(j)) & U(1)) << lane.astype(U), starts)
    return out


def within_radius(queries: np.ndarray, planes: np.ndarray, q: np.ndarray, w: np.ndarray, unused: np.ndarray, every: int = 8):
    """For each pair (query q, word w) the lanes within 3 bits: (positions of pairs that have any, their lanes as bits).

    count1 and count0 hold a lane's distance, ``over`` that it has passed 3. Unused lanes are over from the start.
    """
    at = np.arange(len(q))
    over, count0, count1 = unused[w].copy(), np.zeros(len(q), dtype=U), np.zeros(len(q), dtype=U)
    for j in range(64):
        differs = planes[j][w] ^ (U(0) - ((queries[q] >> U(j)) & U(1)))
        carry = count0 & differs
        count0 ^= differs
        over |= count1 & carry
        count1 ^= carry
        if j % every == every - 1:
            open_ = over != FULL
            if not open_.all():
                at, q, w, over, count0, count1 = at[open_], q[open_], w[open_], over[open_], count0[open_], count1[open_]
                if not len(at):
                    break
    return at, ~over


class _Merged:
    """Components of the fingerprints at hand; ``add`` gives the links that joined two of them."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray):
        while True:
            x, y = self.of[a], self.of[b]
            new = x != y
            a, b, low, high = a[new], b[new], np.minimum(x, y)[new], np.maximum(x, y)[new]
            if not len(a):
                return
            high, first = np.unique(high, return_index=True)
            yield from zip(a[first].tolist(), b[first].tolist(), strict=True)
            to = np.arange(len(self.of))
            to[high] = low[first]
            while (to[to] != to).any():
                to = to[to]
            self.of = to[self.of]


def spanning_links(groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]], p: SimHash):
    """groups of (fingerprints, indices of queries, indices of lanes) -> (group, i, j) that link each group as all its pairs within the radius would."""
    prints = np.concatenate([g[0] for g in groups])
    base = np.cumsum([0, *(len(g[0]) for g in groups)])
    lanes, words, lane_of, query, first, many, n_words = [], [], [], [], [], [], 0
    for (_, asks, answers), b in zip(groups, base.tolist(), strict=False):
        n = -(-len(answers) // 64)
        lanes.append(answers + b)
        words.append(n_words + np.arange(len(answers)) // 64)
        lane_of.append(np.arange(len(answers)) % 64)
        query.append(asks + b)
        first.append(np.full(len(asks), n_words))
        many.append(np.full(len(asks), n))
        n_words += n
    lanes, words, lane_of, query, first, many = map(np.concatenate, (lanes, words, lane_of, query, first, many))
    planes = _planes(prints[lanes], words, lane_of, n_words)
    lane_at = np.zeros((n_words, 64), dtype=np.int64)
    lane_at[words, lane_of] = lanes
    unused = np.full(n_words, FULL)
    np.bitwise_and.at(unused, words, ~(U(1) << lane_of.astype(U)))
    merged, ends = _Merged(len(prints)), np.cumsum(many)
    begin = 0
    while begin < len(query):
        stop = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + p.pairs, side="right")))
        sizes = many[begin:stop]
        q = np.repeat(query[begin:stop], sizes)
        w = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first[begin:stop], sizes)
        at, near = within_radius(prints, planes, q, w, unused)
        pair, lane = np.nonzero(np.unpackbits(near.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        a, b = q[at[pair]], lane_at[w[at[pair]], lane]
        for i, j in merged.add(a, b):
            g = int(np.searchsorted(base, i, side="right")) - 1
            yield g, i - int(base[g]), j - int(base[g])
        begin = stop


def _linker(p: SimHash):
    """Rows (key, lo, hi, mine, id) in order of (key, lo, hi); small groups are compared together."""

    def links(groups):
        found = [(int(groups[g][0][i]), int(groups[g][0][j])) for g, i, j in spanning_links(groups, p)]
        a, b = np.array(found, dtype=U).reshape(-1, 2).view(np.int64).T
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        held, size = [], 0
        for rows in _groups(batches, ["key", "lo", "hi"]):
            prints, mine = rows.column("id").to_numpy().view(U), rows.column("mine").to_numpy()
            lo, hi = rows.column("lo")[0].as_py(), rows.column("hi")[0].as_py()
            held.append((prints, np.flatnonzero(mine == lo), np.flatnonzero(mine == hi)))
            size += len(prints)
            if size >= p.block:
                yield links(held)
                held, size = [], 0
        if held:
            yield links(held)

    return run


def _keys(print_: Column, p: SimHash) -> Column:
    """The ten keys of a fingerprint: two of its five blocks of bits each, and the number of the pair."""
    kept = []
    for i, pair in enumerate(combinations(p.cuts, 2)):
        mask = sum(((1 << (b - a)) - 1) << a for a, b in pair)
        mask = mask - (1 << 64) if mask >= 1 << 63 else mask
        kept.append(F.xxhash64(F.lit(i), print_.bitwiseAND(F.lit(mask).cast("long"))))
    return F.array(*kept)


def fingerprint_links(prints: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """prints (id long: distinct fingerprints) -> (a, b): links within the radius that span what all of them would.

    A bucket's key is a 64-bit hash of its bits; two buckets with one hash are
    compared as one, which costs time and changes nothing.
    """
    banded = prints.select("id", F.explode(_keys(F.col("id"), params)).alias("key"))
    buckets = materialise(banded.groupBy("key").agg(F.count("*").alias("n_members")).where("n_members > 1"), "buckets")
    members = _block_pairs(keyed_join(banded, buckets, ["key"], "n_members"), params.block)
    keys = ["key", "lo", "hi"]
    grouped = members.select(*keys, "mine", "id").repartition(*keys).sortWithinPartitions(*keys)
    return materialise(grouped.mapInArrow(_linker(params), "a long, b long"), "links")


def simhash_dedup(docs: DataFrame, params: SimHash = SimHash()) -> DataFrame:
    """docs (doc_id long, text string, ...) -> doc_id, fingerprint, component_id.

    One row per input row, each a document of its own. A null, empty or blank
    text has the fingerprint 0 and is linked like any other; with fewer words
    than a shingle the whole sequence is one. component_id is the smallest
    doc_id of the rows reachable; rows without a doc_id take part and give none,
    so a component of only such rows has null. Texts of any length are taken
    whole. Other columns are ignored; an empty table gives an empty result.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    rows = materialise(slim.mapInArrow(_printer(params), "doc_id long, print long"), "fingerprints")
    prints = materialise(rows.groupBy(F.col("print").alias("id")).agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")), "prints")
    labels = materialise(connected(fingerprint_links(prints.select("id"), params)), "labels")
    known = prints.join(labels, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    known = materialise(known, "known")
    least = known.groupBy("comp").agg(F.min("first").alias("component_id"), F.count("*").alias("n_prints"))
    named = keyed_join(known, materialise(least, "least"), ["comp"], "n_prints").select(F.col("id").alias("print"), "copies", "component_id")
    out = keyed_join(rows, materialise(named, "named"), ["print"], "copies")
    return out.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
