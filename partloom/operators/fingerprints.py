"""Greedy matching by shape hash and volume, without a row for each candidate pair.

New parts in order each take the best old part still free. Which that is depends
on the hash and on volumes that lie close, so the parts of a slab of volumes are
walked in one task over trees that give the first free part between two volumes.
"""

from __future__ import annotations

import math
from array import array
from bisect import bisect_left, bisect_right
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.operators.prefix import ranked
from partloom.tables import dealt, merged, written

#: Width of a slab in log volume, and how far apart in it two volumes within 5 % may lie.
WIDTH, REACH = 0.1, -math.log(0.95) + 1e-9
#: Parts without a usable volume match by hash alone; they are dealt over so many blocks.
LOOSE = 64
_SIZES = ("sx", "sy", "sz")
_KEPT = "n long, o long, confidence double, b0 long, b1 long"
_MANY = 1 << 62
#: Old parts of one hash that are looked through one by one; more get a tree of their own.
FEW = 64


def _flat(values: np.ndarray, kind: str) -> array:
    """As many bytes, but faster to read one by one."""
    out = array(kind)
    out.frombytes(np.ascontiguousarray(values, "float64" if kind == "d" else "int64").tobytes())
    return out


class Free:
    """Places of free parts by volume, in a tree of least places: the first between two volumes that is fit."""

    def __init__(self, volumes: np.ndarray, places: np.ndarray):
        self.volumes, self.size = _flat(volumes, "d"), 1 << max(0, len(places) - 1).bit_length()
        least = np.full(2 * self.size, _MANY, "int64")
        least[self.size : self.size + len(places)] = places
        at = self.size
        while at > 1:
            least[at // 2 : at] = least[at : 2 * at].reshape(-1, 2).min(axis=1)
            at //= 2
        self.least = _flat(least, "q")

    def take(self, at: int) -> None:
        i = at + self.size
        self.least[i] = _MANY
        while i > 1:
            i >>= 1
            now = min(self.least[2 * i], self.least[2 * i + 1])
            if self.least[i] == now:
                return
            self.least[i] = now

    def first(self, low: float, high: float, fit) -> int:
        left, right = bisect_left(self.volumes, low) + self.size, bisect_right(self.volumes, high) + self.size
        open_ = []
        while left < right:
            if left & 1:
                open_.append((self.least[left], left))
                left += 1
            if right & 1:
                right -= 1
                open_.append((self.least[right], right))
            left >>= 1
            right >>= 1
        heapify(open_)
        while open_:
            place, i = heappop(open_)
            if place == _MANY:
                break
            if fit(place):
                return place
            if i < self.size:
                heappush(open_, (self.least[2 * i], 2 * i))
                heappush(open_, (self.least[2 * i + 1], 2 * i + 1))
        return _MANY


def gap(a: float, b: float) -> float:
    return abs(a - b) / max(a, b, 1e-10)


def alike(a: tuple, b: tuple, least: float) -> bool:
    """Whether two boxes resemble each other more than that; NaN stands for a null, infinity for NaN, which is above all numbers."""
    if any(x != x for x in (*a, *b)):
        return False
    e = [abs(x - y) / max(abs(x), abs(y), 1e-10) for x, y in zip(a, b, strict=True)]
    return not 1.0 - (e[0] + e[1] + e[2]) / 3.0 <= least


def between(v: float, tol: float) -> tuple[float, float]:
    """Bounds of the volumes whose gap to v may be within tol, a hair too wide."""
    low, high = v - tol * max(v, 1e-10), max(v / (1 - tol), v + tol * 1e-10)
    return low - 1e-9 * abs(low) - 1e-22, high + 1e-9 * abs(high) + 1e-22


class _Olds:
    """The old parts of a block in order, some numbers for each: which is the first still free of those that are fit."""

    def __init__(self, columns: dict[str, np.ndarray]):
        place, first = np.unique(columns["place"], return_index=True)
        self.place, volume, code = _flat(place, "q"), columns["volume"][first], columns["code"][first]
        self.volume = _flat(volume, "d")
        self.sizes = [_flat(columns[k][first], "d") for k in _SIZES]
        self.taken = bytearray(len(place))
        solid = np.flatnonzero(np.isfinite(volume))
        self.every, self.at_every = self._tree(volume, solid)
        order = np.argsort(code, kind="stable")
        self.codes, self.order = code[order], _flat(order, "q")
        self.code, self.large, self.at_large = _flat(code, "q"), {}, None
        held = columns["held"][first]
        holding = np.flatnonzero(held >= 0)
        holding = holding[np.argsort(held[holding], kind="stable")]
        self.held, self.holding = _flat(held[holding], "q"), _flat(holding, "q")

    def _tree(self, volume: np.ndarray, members: np.ndarray) -> tuple[Free, array]:
        """A tree over some parts, by volume, and where each part stands in it."""
        sized = members[np.argsort(volume[members], kind="stable")]
        at = np.full(len(volume), -1, "int64")
        at[sized] = np.arange(len(sized))
        return Free(volume[sized], sized), _flat(at, "q")

    def ranges(self, codes: np.ndarray) -> tuple[array, array]:
        """From where to where the parts of each hash stand in ``order``; nowhere for no hash."""
        low, high = (np.searchsorted(self.codes, codes, side) for side in ("left", "right"))
        return _flat(low, "q"), _flat(np.where(codes < 0, low, high), "q")

    def take(self, i: int) -> None:
        self.taken[i] = 1
        if self.at_every[i] >= 0:
            self.every.take(self.at_every[i])
        if tree := self.large.get(self.code[i]):
            tree.take(self.at_large[i])

    def box(self, i: int) -> tuple:
        return tuple(k[i] for k in self.sizes)

    def near(self, v: float, tol: float, size=None, least: float = 0.0) -> int:
        """The first whose volume is within tol of v, and whose box is alike if that is asked for."""
        volume = self.volume
        return self.every.first(*between(v, tol), lambda i: gap(v, volume[i]) <= tol and (size is None or alike(size, self.box(i), least)))

    def of_hash(self, low: int, high: int, v: float | None = None, tol: float = 0.0) -> int:
        """The first of those from low to high in ``order``, and within tol of v if that is given."""
        order, taken, volume = self.order, self.taken, self.volume
        if high - low <= FEW:
            for at in range(low, high):
                i = order[at]
                if not taken[i] and (v is None or gap(v, volume[i]) <= tol):
                    return i
            return _MANY
        code = self.code[order[low]]
        if code not in self.large:
            if self.at_large is None:
                self.at_large = array("q", bytes(8 * len(volume)))
            members = np.array(order[low:high], "int64")
            volumes = np.array([volume[i] for i in members.tolist()])
            volumes[np.isnan(volumes)] = math.inf
            sized = np.argsort(volumes, kind="stable")
            self.large[code] = Free(volumes[sized], members[sized])
            for at, i in enumerate(members[sized].tolist()):
                self.at_large[i] = at
                if taken[i]:
                    self.large[code].take(at)
        tree = self.large[code]
        return tree.first(-math.inf, math.inf, lambda i: True) if v is None else tree.first(*between(v, tol), lambda i: gap(v, volume[i]) <= tol)


def _walk(table: pa.Table) -> pa.Table:
    """A block's new and old parts -> what each new one takes, in order, of what no earlier part holds."""
    kind = table.column("kind").to_numpy()

    def side(which: int, names: tuple) -> dict[str, np.ndarray]:
        rows = np.flatnonzero(kind == which)
        return {c: table.column(c).to_numpy()[rows] for c in names}

    olds = _Olds(side(1, ("place", "volume", "code", "held", *_SIZES)))
    news = side(0, ("place", "volume", "code", "b0", "b1", *_SIZES))
    order = np.argsort(news["place"], kind="stable")
    low, high = olds.ranges(news["code"][order])
    column = {c: _flat(x[order], "d" if c == "volume" or c in _SIZES else "q") for c, x in news.items() if c != "code"}
    del news, order
    # A part held elsewhere is free until the turn of its holder.
    passed, out = 0, {"n": array("q"), "o": array("q"), "confidence": array("d"), "b0": array("q"), "b1": array("q")}
    for n, v, b0, b1, low_, high_, *size in zip(*(column[c] for c in ("place", "volume", "b0", "b1")), low, high, *(column[k] for k in _SIZES), strict=True):
        while passed < len(olds.held) and olds.held[passed] < n:
            olds.take(olds.holding[passed])
            passed += 1
        size, same, solid = tuple(size), high_ > low_, math.isfinite(v)
        found, score = _MANY, 0.95
        if same and solid:
            found = olds.of_hash(low_, high_, v, 0.001)
        if found == _MANY and solid:
            found, score = olds.near(v, 0.001, size, 0.9), 0.85
            if same:
                found = min(found, olds.of_hash(low_, high_, v, 0.01))
        if found == _MANY and same:
            found, score = olds.of_hash(low_, high_), 0.80
        if found == _MANY and solid:
            found, score = olds.near(v, 0.01, size, 0.8), 0.70
        if found == _MANY and solid:
            found, score = olds.near(v, 0.05), 0.60
        if found != _MANY:
            olds.take(found)
            for c, x in zip(out, (n, olds.place[found], score, b0, b1), strict=True):
                out[c].append(x)
    return pa.table({c: np.frombuffer(x, "float64" if c == "confidence" else "int64") if x else np.array([], "float64" if c == "confidence" else "int64") for c, x in out.items()})


def _slab(log: Column, shifted: int) -> Column:
    return F.floor(log / WIDTH + 0.5 * shifted).cast("long")


def _placed(parts: DataFrame, side: str) -> DataFrame:
    """part_id, the place in the order of (ord, part_id), hash, volume (null unless finite), log volume and sizes."""
    rows = ranked(parts.select("part_id", "ord", "topology_hash", "volume", *_SIZES), [], ["ord", "part_id"], "place")
    v = F.col("volume").cast("double")
    sizes = [F.when(F.isnan(F.col(k).cast("double")), F.lit(math.inf)).otherwise(F.col(k).cast("double")).alias(k) for k in _SIZES]
    finite = F.when(F.abs(v) < math.inf, v)
    return written(rows.select("part_id", "place", F.col("topology_hash").cast("string").alias("hash"), finite.alias("volume"), F.log(F.greatest(finite, F.when(finite.isNotNull(), 1e-10))).alias("log"), *sizes), side)


def greedy(new: DataFrame, old: DataFrame) -> DataFrame:
    """new_id, old_id, confidence: in order of (ord, part_id) each new part takes the best old part still free, the first in order on ties.

    Scores are those of ``reconcile.fingerprint_score``, of at least 0.60. The choice is the stable matching in which
    old parts prefer earlier new ones, found by deferred acceptance between slabs: each is walked by itself, an old part
    that two slabs took stays with the earlier part, and slabs that lost one are walked again. Slabs are shifted by half
    their width each time, so what met at an edge lies inside next. A slab is walked in one task, with a few numbers
    for each of its parts and for the old ones within 5 % of it or of a hash in it.
    """
    news, olds = _placed(new, "news"), _placed(old, "olds")
    # Hashes are only compared with one another, so parts travel with a number for each that a new one has; -1 for others.
    codes = written(news.where("hash is not null").select("hash").distinct().withColumn("code", F.monotonically_increasing_id()), "codes")
    news, olds = (written(merged(p).join(merged(codes), "hash", "left").na.fill(-1, ["code"]), side) for p, side in ((news, "news"), (olds, "olds")))
    loose = -(10**6) - F.pmod(F.xxhash64("hash"), F.lit(LOOSE))
    block = [F.coalesce(_slab(F.col("log"), s), loose).alias(f"b{s}") for s in (0, 1)]
    turns = written(news.where("volume is not null or hash is not null").select("place", "volume", "code", *_SIZES, *block), "turns")
    met = []
    for s in (0, 1):
        blocks = turns.select(F.col(f"b{s}").alias("block")).distinct()
        columns = ["block", "place", "volume", "code", *_SIZES]
        near = olds.where("log is not null").withColumn("block", F.explode(F.sequence(_slab(F.col("log") - REACH, s), _slab(F.col("log") + REACH, s)))).join(blocks, "block", "left_semi")
        named = merged(olds.where("code >= 0")).join(merged(turns.where("code >= 0").select("code", F.col(f"b{s}").alias("block")).distinct()), "code")
        met.append(written(near.select(*columns).union(named.select(*columns)), "met"))
    kept = written(new.sparkSession.createDataFrame([], _KEPT), "kept")
    lost, shifted = None, 0
    while lost is None or not lost.isEmpty():
        own = f"b{shifted}"
        active = (turns if lost is None else lost).select(F.col(own).alias("block")).distinct()
        asking = turns.withColumn("block", F.col(own)).join(active, "block", "left_semi")
        holders = kept.select(F.col("o").alias("place"), F.col("n").alias("held"), F.col(own).alias("holder"))
        offered = met[shifted].join(active, "block", "left_semi").join(merged(holders), "place", "left")
        elsewhere = F.when(F.col("holder") != F.col("block"), F.col("held")).otherwise(-1)
        none = F.lit(-1).cast("long")
        columns = ["block", "place", "volume", "code", *_SIZES]
        rows = asking.select(*columns, F.lit(0).alias("kind"), none.alias("held"), "b0", "b1")
        rows = rows.union(offered.select(*columns, F.lit(1), elsewhere, none, none))
        taken = dealt(rows, "block").groupBy("block").applyInArrow(_walk, _KEPT)
        quiet = kept.join(active.withColumnRenamed("block", own), own, "left_anti").select("n", "o", "confidence", "b0", "b1")
        made = written(quiet.union(taken), "made")
        contested = made.groupBy("o").agg(F.min("n").alias("first"), F.count("*").alias("claims")).where("claims > 1").select("o", "first")
        marked = written(made.join(merged(contested), "o", "left").withColumn("lost", F.coalesce(F.col("n") != F.col("first"), F.lit(False))), "marked")
        kept = marked.where("not lost").select("n", "o", "confidence", "b0", "b1")
        lost, shifted = marked.where("lost"), 1 - shifted
    out = merged(kept).join(merged(news.select(F.col("place").alias("n"), F.col("part_id").alias("new_id"))), "n").join(merged(olds.select(F.col("place").alias("o"), F.col("part_id").alias("old_id"))), "o")
    return out.select("new_id", "old_id", "confidence")
